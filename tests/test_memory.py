import datetime as dt
import io
import json
import os
import time
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark import __main__ as command
from mnemospark.memory import Memory, embedded, respond
from mnemospark.operators import pointers, snapshots
from mnemospark.sources import files
from mnemospark.streaming import watch

NOW = dt.datetime(2026, 6, 10, tzinfo=dt.timezone.utc)


def _pdf(*contents: bytes) -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"1 0 obj <<>>\nstream\r\n" + c + b"\nendstream\nendobj\n" for c in contents)


def _epub(chapters: dict[str, str], spine: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        items = "".join(f'<item id="i{n}" href="../text/{name}"/>' for n, name in enumerate(chapters))
        refs = "".join(f'<itemref idref="i{[*chapters].index(name)}"/>' for name in spine)
        z.writestr("book/meta/content.opf", f"<package>{items}{refs}</package>")
        for name, html in chapters.items():
            z.writestr(f"book/text/{name}", html)
    return out.getvalue()


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "notes"
    (folder / "deep").mkdir(parents=True)
    (folder / "node_modules").mkdir()
    (folder / "pricing.md").write_text("# Pricing\n\n2026-05-20 - we chose a free tier with ten credits per month.\n")
    (folder / "old.TXT").write_text("2026-01-10 - pricing was one flat plan.\n")
    (folder / "deep/page.html").write_text("<html><body><p>database &amp; stack: postgres over mongo</p></body></html>")
    (folder / "deep/paper.pdf").write_bytes(_pdf(zlib.compress(b"BT (Billing \\(invoice\\)) Tj T* <0065007500720020> Tj ET"), b"no text (here)"))
    (folder / "deep/book.epub").write_bytes(_epub({"b.xhtml": "<p>second chapter</p>", "a.xhtml": "<p>first chapter</p>"}, ["a.xhtml", "b.xhtml"]))
    (folder / "bad.epub").write_bytes(b"not a zip file")
    (folder / "picture.png").write_bytes(b"\x00")
    (folder / ".hidden.md").write_text("hidden")
    (folder / "node_modules/skipped.md").write_text("skipped")
    return str(folder)


def test_walk_takes_known_files(spark, notes):
    found = {os.path.basename(r.source) for r in files.walk(spark, [notes]).collect()}
    assert found == {"pricing.md", "old.TXT", "page.html", "paper.pdf", "book.epub", "bad.epub"}
    with pytest.raises(FileNotFoundError):
        files.walk(spark, [notes + "/nowhere"])


def test_walk_judges_folders_from_its_target_on(spark, tmp_path):
    for name in ("build/notes/a.md", "build/notes/dist/b.md", "build/notes/deep/build/c.md", "build/notes/building/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    names = lambda *paths: sorted(os.path.basename(r.source) for r in files.walk(spark, [str(tmp_path / p) for p in paths]).collect())
    assert names("build/notes") == names("build/notes/") == ["a.md", "d.md"]
    assert names("build") == [] and names("build/notes/a.md") == ["a.md"] and names("build/notes", "build/notes/deep") == ["a.md", "d.md"]


def test_extraction(spark, notes):
    rows = {os.path.basename(r.source): r for r in files.extracted(files.contents(spark, [notes], files.walk(spark, [notes]))).collect()}
    assert rows["page.html"].text == "database & stack: postgres over mongo"
    assert rows["paper.pdf"].text == "Billing (invoice)\neur"
    assert rows["book.epub"].text == "first chapter\n\nsecond chapter"
    assert rows["bad.epub"].text is None and "zip" in rows["bad.epub"].error.lower()


@pytest.mark.parametrize(("content", "text"), [
    (b"BT (a\\101\\n(b)) Tj ET", "aA\n(b)"), (b"BT <48656C6C6F> Tj 1 0 Td (x) Tj ET", "Hello\nx"), (b"BT <0001000200030004> Tj ET", ""), (b"(outside)", ""), (b"BT (open", "open")])
def test_pdf_strings(content, text):
    assert files.pdf_text(_pdf(content)) == text


def test_pdf_streams_by_their_dictionaries():
    page = b"BT (one endstream two) Tj ET"
    packed = zlib.compress(b"BT (three) Tj ET")
    data = b"%PDF-1.7\n1 0 obj\n<< /Length 9 0 R /Note (a >> b \\( c) /Inner << /Length 3 >> >>\nstream\n" + page + b"\nendstream\nendobj\n"
    data += b"9 0 obj\n%d\nendobj\n" % len(page)
    data += b"2 0 obj << /Filter [/FlateDecode] /Length %d >> stream\r\n" % len(packed) + packed + b"\r\nendstream endobj\n"
    data += b"3 0 obj << /Subtype /Image /Filter /DCTDecode /Length 16 >> stream\nBT (image) Tj ET\nendstream endobj\n"
    data += b"4 0 obj << /Length 999999 >> stream\nBT (wrong length) Tj ET\nendstream endobj\n"
    data += b"5 0 obj << /Filter /FlateDecode /Length 5 >> stream\nxxxxx\nendstream endobj\n6 0 obj << /Length 3 >> stream\nBT"
    assert files.pdf_text(data) == "one endstream two\nthree\nwrong length"
    assert files.pdf_text(b"") == files.pdf_text(b"%PDF-1.4\n1 0 obj << /A") == ""


def test_epub_packages_with_prefixes_and_other_quotes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("OPS/b.opf", "<opf:package><opf:item href='x%20y.xhtml' id='p'/><opf:item id='q' href=\"./sub/../z&amp;.html\"/><opf:item id='c' href='s.css'/>"
                   "<opf:itemref idref='q'/><opf:itemref idref='none'/><opf:itemref idref='c'/><opf:itemref idref='p'/></opf:package>")
        z.writestr("OPS/x y.xhtml", "X")
        z.writestr("OPS/z&.html", "Z")
        z.writestr("OPS/extra.html", "E")
    assert files.epub_chapters(out.getvalue()) == ["Z", "X"]


def test_epub_without_a_spine_goes_by_names():
    assert files.epub_chapters(_epub({"b.html": "B", "a.html": "A"}, [])) == ["A", "B"]


def test_ingest_is_incremental_and_idempotent(spark, notes, tmp_path):
    memory = Memory(spark, str(tmp_path / "store"), clock=lambda: NOW)
    first = memory.ingest([notes])
    assert (first["files"], first["changed"], first["unchanged"], first["chunks"]) == (6, 5, 0, 5)
    assert [os.path.basename(f["file"]) for f in first["failed"]] == ["bad.epub"]
    again = memory.ingest([notes])
    assert (again["changed"], again["unchanged"], again["chunks"]) == (0, 5, 0)
    with open(notes + "/old.TXT", "w") as f:
        f.write("2026-01-10 - pricing was two plans.\n")
    os.utime(notes + "/old.TXT", (1, 2_000_000_000))
    assert memory.ingest([notes])["chunks"] == 1 and memory.status()["chunks"] == 5
    assert memory.ingest([notes], force=True)["changed"] == 5 and memory.status() | {"updated_at": 0} == {"chunks": 5, "sources": 5, "with_embedding": 0, "updated_at": 0}
    assert Memory(spark, str(tmp_path / "store")).status()["chunks"] == 5
    memory.store = snapshots.compacted(spark, str(tmp_path / "store"), memory.store, most=0)
    assert len(snapshots.prune(spark, str(tmp_path / "store"))) >= 2 and Memory(spark, str(tmp_path / "store")).status()["chunks"] == 5


def test_recall_reinforce_forget(spark, notes, tmp_path):
    memory = Memory(spark, str(tmp_path / "store"), clock=lambda: NOW)
    assert memory.recall("pricing") == [] and "No memories" in memory.passages("pricing")
    memory.ingest([notes])
    found = memory.recall("pricing plan")
    assert [os.path.basename(f["source"]) for f in found] == ["old.TXT", "pricing.md"]
    assert found[1]["lines"] == [1, 4] and found[1]["date"] == "2026-05-20" and found[1]["citation"].endswith("pricing.md:1-4") and found[1]["snippet"].startswith("# Pricing")
    assert [os.path.basename(f["source"]) for f in memory.recall("pricing", since="1m")] == ["pricing.md"] and memory.recall("pricing", until="2020-01-01") == []
    assert memory.recall("zebra") == [] and len(memory.recall("pricing", limit=1)) == 1
    before = memory.recall("free credits")[0]["score"]
    assert len(memory.reinforce("free credits", "pricing.md")) == 1 and memory.reinforce("x", "nowhere") == []
    assert memory.recall("free credits")[0]["score"] == pytest.approx(before + 0.1347, abs=2e-4)
    assert memory.forget("pricing") == 1 and memory.recall("free credits") == []
    assert memory.store.feedback.count() == 0


def test_remember(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "store"), clock=lambda: NOW)
    assert memory.remember("the launch moved to 2026-07-01", "chat") == {"added": 1, "chunks": 1}
    assert memory.remember("the launch moved to 2026-07-01", "chat")["added"] == 0
    assert memory.remember("... !!", "chat")["added"] == 0
    row = memory.store.chunks.first()
    assert row.date == "2026-07-01" and row.when_ts == NOW.replace(tzinfo=None) and row.source == "chat"
    memory.remember("budget note", "chat", "2026-02-31")
    assert memory.store.chunks.where("date = '2026-02-31'").first().when_ts == dt.datetime(2026, 3, 3)


def test_embeddings_and_answers(spark, notes, tmp_path):
    def embed(text: str) -> list[float]:
        if "flat" in text:
            raise ValueError("too long")
        return [1.0, 0.0] if "chapter" in text or "story" in text else [0.0, 1.0]

    memory = Memory(spark, str(tmp_path / "store"), embed=embed, chat=lambda system, user: f"answer from {user.count('[1]')}", clock=lambda: NOW)
    memory.ingest([notes])
    assert memory.status()["with_embedding"] == 4
    assert os.path.basename(memory.recall("story")[0]["source"]) == "book.epub"
    assert memory.ask("pricing") == "answer from 1"
    memory.chat = lambda *_: 1 / 0
    assert memory.ask("pricing").startswith("[1] ")

    def broken(text: str) -> list[float]:
        raise ValueError("no model")

    with pytest.raises(RuntimeError, match="no model"):
        embedded(spark.createDataFrame([("a",)], "text string"), broken)


def test_parts_of_another_tokenizer_are_migrated(spark, tmp_path):
    path = str(tmp_path / "store")
    memory = Memory(spark, path, clock=lambda: NOW)
    memory.remember("running tests", "a")
    old = memory.store.chunks.withColumns({"terms": F.array(F.lit("old")), "id": F.lit("other"), "text": F.lit("walked dogs")})
    snapshots.change(spark, path, memory.store, added=old)
    state = pointers.latest(spark, path, snapshots.NAME)
    assert sorted(r.terms[0] for r in Memory(spark, path).store.chunks.collect()) == ["old", "run"]
    state["chunks"][1]["tokenizer"] = 2
    pointers.publish(spark, path, snapshots.NAME, state)
    assert sorted(r.terms[0] for r in Memory(spark, path).store.chunks.collect()) == ["run", "walk"]


def test_requests(spark, notes, tmp_path, capsys):
    memory = Memory(spark, str(tmp_path / "store"), clock=lambda: NOW)
    ask = lambda method, **params: respond(memory, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert respond(memory, "{")["error"]["code"] == -32700 and respond(memory, "[]")["error"]["code"] == -32600
    assert ask("nothing")["error"]["code"] == -32601 and ask("tools/call", name="x")["error"]["code"] == -32602
    assert respond(memory, '{"jsonrpc": "2.0", "method": "initialized"}') is None and ask("ping")["result"] == {}
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == {"recall", "remember", "reinforce", "status"}
    call = lambda name, **given: ask("tools/call", name=name, arguments=given)["result"]
    assert call("recall")["isError"] and "1 memories" in call("remember", text="alpha beta", source="s")["content"][0]["text"]
    assert call("recall", query="alpha")["content"][0]["text"].startswith("[1] s:1-1")
    assert "Reinforced: s" in call("reinforce", query="alpha", source="s")["content"][0]["text"] and "1 chunks" in call("status")["content"][0]["text"]
    command.run(memory, command.parser().parse_args(["--store", "x", "recall", "alpha", "--json"]))
    assert json.loads(capsys.readouterr().out)[0]["source"] == "s"


def _until(query, holds) -> None:
    for _ in range(150):
        if query.exception() is not None:
            raise query.exception()
        if holds():
            return
        time.sleep(0.2)
    raise AssertionError("the watch didn't get there")


def test_watch_ingests_changes(spark, notes, tmp_path):
    memory, errors = Memory(spark, str(tmp_path / "store"), clock=lambda: NOW), []
    names = lambda: {os.path.basename(r.source) for r in memory.store.chunks.select("source").collect()}
    query = memory.watch([notes], "200 milliseconds", errors.append, forget_removed=True)
    try:
        assert memory.status()["chunks"] == 5
        _until(query, lambda: memory.store.state.get("watched"))  # the files that were there have been told
        with open(notes + "/deep/new.md", "w") as f:
            f.write("a new note about zebras\n")
        _until(query, lambda: "new.md" in names())
        assert memory.recall("zebras")[0]["source"].endswith("new.md")
        os.remove(notes + "/pricing.md")
        _until(query, lambda: "pricing.md" not in names())
    finally:
        query.stop()
    number = memory.store.state["number"]
    with open(notes + "/later.md", "w") as f:
        f.write("written while nobody watched\n")
    query = memory.watch([notes], "200 milliseconds", errors.append, forget_removed=True)  # goes on from its checkpoint
    try:
        assert "later.md" in names() and memory.store.state["number"] > number
        os.remove(notes + "/old.TXT")
        _until(query, lambda: "old.TXT" not in names())
    finally:
        query.stop()
    # bad.epub has no chunks, so it is reported as failed and not held; no batch failed
    assert names() == {"page.html", "paper.pdf", "book.epub", "new.md", "later.md"} and not errors
    assert len(memory.store.state["watched"]) == 1


class _State:
    """What a step sees of its state."""

    hasTimedOut, exists, get, wait = False, False, None, None

    def update(self, new):
        self.exists, self.get = True, new

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_a_file_is_told_once_it_is_quiet():
    state, step = _State(), watch.told(600)
    see = lambda at, mtime, length=1: [r.kind for d in step(("a",), iter([pd.DataFrame({"seen": [at], "mtime": [mtime], "length": [length]})]), state) for r in d.itertuples()]
    burst = [see(100 * i, 100 * i) for i in range(10)]
    assert burst == [[]] * 10 and see(1400, 900) == [] and see(1500, 900) == ["added"] and see(9000, 900) == [] and state.wait == 600
    assert see(9100, 900, 2) == [] and see(9699, 900, 2) == [] and see(9700, 900, 2) == ["changed"]
    assert see(9800, 950) == [] and see(9900, 900, 2) == [] and see(10600, 900, 2) == []  # as it was told before
    state.hasTimedOut = True
    assert [r.kind for d in step(("a",), iter([]), state) for r in d.itertuples()] == ["removed"] and not state.exists
    state.update((1, 1, 0, -1, -1))
    assert not [*step(("a",), iter([]), state)]  # gone before it was told


def test_watch_takes_what_a_walk_takes(spark, notes, tmp_path):
    reader = watch.Listing([notes, notes + "/pricing.md"])
    listed = {row[0]: row[1] for p in reader.partitions({"ms": 0}, {"ms": 1}) for row in reader.read(p)}
    walked = {r.source: int(r.mtime.replace(tzinfo=dt.timezone.utc).timestamp() * 1000 + 0.5) for r in files.walk(spark, [notes]).collect()}
    assert listed == walked
    assert watch.taken("/build/x/a.md", "/build/x") and not watch.taken("/x/build/a.md", "/x/build") and not watch.taken("/x/y/.z/a.md", "/x")


def test_a_batch_that_comes_again_is_dropped(spark, tmp_path):
    path = str(tmp_path / "store")
    now = snapshots.change(spark, path, snapshots.load(spark, path), watched={"s": 3})
    now = snapshots.change(spark, path, now, watched={"t": 1})
    assert snapshots.load(spark, path).state["watched"] == {"s": 3, "t": 1}


def test_migrated_terms_are_made_in_batches(spark):
    """The terms of an older tokenizer are made anew as those of new texts are, not step by step for each token; other columns stay in their places."""
    old = spark.createDataFrame([(1, "Queries and caches", ["old"], 1, "s"), (2, None, ["old"], 1, "s"), (3, "", None, 0, None)], "id long, text string, terms array<string>, len int, source string")
    new = snapshots.migrated(old)
    assert new.columns == old.columns and "MapInArrow" in new._jdf.queryExecution().toString()
    assert sorted(map(tuple, new.collect()), key=lambda r: r[0]) == [(1, "Queries and caches", ["queri", "cach"], 2, "s"), (2, None, [], 0, "s"), (3, "", [], 0, None)]
