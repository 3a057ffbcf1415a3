"""Personal data by candidate gradient boosting (DataFrame functions only).

1. Base patterns with their checks give the sure spans of four kinds: email, ip, card, phone.
2. Generators of high recall, one for each kind, propose looser candidates (obfuscated addresses, numbers without the
   international prefix, other groupings).  For training they run over the whole text, for selection over the text with
   the base spans of their kind blanked, so that what they add overlaps none of those.
3. A candidate is described by format and context in a few small bins, after "[at]" and "[dot]" are read as the signs
   they stand for.  Its weak label is evidence that the bins don't show: a letter domain at the end (email), parts at
   most 255 (ip), the Luhn sum (card), a plus sign or a word like "tel" before it (phone).  Over all documents the candidates
   are counted by bins and label, in two halves of the documents.  The table has at most as many rows as there are combinations.
4. Gradient-boosted trees of depth two are fitted on one half and become one SQL expression; on the other half an isotonic
   fit turns their scores into shares of the label.  The lowest score whose share is ``precision`` or more is the
   threshold of its kind; candidates from there on are added.  (So numbers of a format are added without evidence of their
   own once nine in ten of that format and context have it.)

Positions are code points, ends exclusive.  Defined cases: null and empty texts have no spans; repeated rows are handled
one by one; without labelled candidates nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import persist, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
TREES, RATE = 40, 0.3

# The contract's base patterns.  (?:(?<!x)|\G)x++ finds the same matches as x+ at the start of a pattern, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:@|\x20?[\[({]at[\])}]\x20?)[a-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[a-z0-9-]++)++",
    "ip": r"(?:(?<![0-9.])|\G)[0-9]{1,3}(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?:(?<![0-9])|\G)[0-9]{4}(?:[\x20./_-]?[0-9]{2,7}){2,4}+",
    "phone": r"(?:(?<![0-9])|\G)\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: The bins of each feature.
FEATURES = {"kind": 4, "digits": 6, "marks": 5, "first": 2, "before": 3, "after": 3, "size": 4, "parts": 4}
#: Folds of arrays go in pieces of so many, as each step copies what it has so far.
PIECE = 64

_SPANS = "array<struct<start:int,stop:int,s:string>>"
_BLANK = "\x01"


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The leftmost matches of ``pattern`` that don't overlap, and what stands before each of them and after the last."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(hits: Column, gaps: Column) -> Column:
    """The matches with their places."""
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"), h.alias("s")))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("stop"), x["s"].alias("s"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def fold(piece: Column) -> Column:
        return F.aggregate(piece, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")), add)

    def shift(piece: Column, base: Column) -> Column:
        return F.transform(piece["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["stop"] + base).alias("stop"), x["s"].alias("s")))

    def shifted(folded: Column) -> Column:
        sums = F.aggregate(folded, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(folded, F.slice(sums, 1, F.size(folded)), shift))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / PIECE).cast("int")), lambda i: fold(F.slice(steps, i * PIECE + 1, F.lit(PIECE))))
    several = F.transform(F.array(pieces), shifted)[0]
    return F.when(F.size(hits) == 0, F.array().cast(_SPANS)).otherwise(several)


def _spans(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), _placed(*_cut(text, pattern))).otherwise(F.array().cast(_SPANS))


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits divides by ten."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    """The contract's check of a match of the base pattern."""
    n = F.length(_digits(s))
    if kind == "ip":
        return s.rlike(_IP_OK)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(s))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _blanked(text: Column, kind: str) -> Column:
    """``text`` with each base span of ``kind`` replaced by as many characters that no generator takes."""
    hits, gaps = _cut(text, BASE[kind])
    covers = F.concat(F.transform(hits, lambda h: F.when(_valid(kind, h), F.repeat(F.lit(_BLANK), F.length(h))).otherwise(h)), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, covers, lambda g, c: F.concat(g, c)), "")


def _character(c: Column, edge: Column) -> Column:
    return F.when(edge | c.rlike(r"[\s.,;:!?]"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(2)


def _plain(s: Column) -> Column:
    """``s`` with "[at]" and "[dot]" as the signs that they stand for."""
    return F.regexp_replace(F.regexp_replace(s, r"(?i)\x20?[\[({]at[\])}]\x20?", "@"), r"(?i)\x20?[\[({]dot[\])}]\x20?", ".")


def _evidence(kind: str, s: Column, before: Column) -> Column:
    """The weak label, from the candidate in plain signs and the text before it."""
    if kind == "email":
        return s.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "phone":
        return before.rlike(r"(?i)(?:\+[0-9 ().-]{0,5}|\b(?:tel|telephone|phone|call|mobile|fax)\b[^0-9\n]{0,12})$")
    return _valid(kind, s)


def _described(text: Column, kind: str, spans: Column) -> Column:
    """Candidates with their bins and weak label."""

    def describe(x: Column) -> Column:
        return F.transform(F.array(F.struct(_plain(x["s"]).alias("s"), x["start"].alias("start"), x["stop"].alias("stop"))), bins)[0]

    def bins(x: Column) -> Column:
        s, digits = x["s"], _digits(x["s"])
        n, size = F.length(digits), F.length(s)
        before, after = F.substring(text, x["start"], F.lit(1)), F.substring(text, x["stop"] + 1, F.lit(1))
        lead = F.greatest(x["start"] - 24, F.lit(0))
        found = {
            "kind": F.lit(KINDS.index(kind)),
            "digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n < 13, 3).when(n < 17, 4).otherwise(5),
            "marks": F.when(s.contains("("), 4).when(s.rlike("[/_]"), 3).when(s.contains("-"), 2).when(s.contains(" "), 1).otherwise(0),
            "first": s.rlike("^[3-6]").cast("int"),
            "before": _character(before, x["start"] == 0),
            "after": _character(after, x["stop"] >= F.length(text)),
            "size": F.when(size < 12, 0).when(size < 17, 1).when(size < 25, 2).otherwise(3),
            "parts": F.least(F.lit(3), F.length(F.regexp_replace(s, r"[^.]", ""))),
        }
        label = _evidence(kind, s, F.substring(text, lead + 1, x["start"] - lead))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), *[v.cast("int").alias(k) for k, v in found.items()], label.alias("label"))

    return F.transform(spans, describe)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(_spans(text, BASE[kind]), lambda x: _valid(kind, x["s"]))


def _free(text: Column, kind: str) -> Column:
    """The described candidates that overlap no base span; their context is that of the text."""
    return _described(text, kind, F.transform(F.array(_blanked(text, kind)), lambda t: _spans(t, LOOSE[kind]))[0])


def proposals(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, half, the base spans of each kind, all described candidates of each row, and those that are free of base spans."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    text = F.col("text")
    df = df.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), *[base_spans(text, k).alias(k) for k in KINDS])
    found = {k: _described(text, k, _spans(text, LOOSE[k])) for k in KINDS}
    free = {k: _free(text, k) for k in KINDS}
    df = df.select("doc_id", "text", "half", *KINDS, *[found[k].alias(f"c_{k}") for k in KINDS])
    bare = lambda k: F.transform(F.col(k), lambda x: F.struct(x["start"], x["stop"])).alias(k)
    return df.select(
        "doc_id", *(["text"] if keep_text else []), "half", *[bare(k) for k in KINDS], F.concat(*[f"c_{k}" for k in KINDS]).alias("candidates"),
        F.concat(*[F.when((F.size(k) > 0) & (F.size(f"c_{k}") > 0), free[k]).otherwise(F.col(f"c_{k}")) for k in KINDS]).alias("free"))


class Boosted:
    """Depth-two trees with logistic loss, fitted on a table of bins with counts and labelled counts."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, yes: np.ndarray, trees: int = TREES, rate: float = RATE):
        self.names, self.rate, self.trees = list(FEATURES), rate, []
        share = (yes.sum() + 0.5) / (n.sum() + 1)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(n), self.start)
        for _ in range(trees if len(n) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = yes - n * p, n * p * (1 - p)
            tree, add = self._grow(bins, grad, hess, np.ones(len(n), dtype=bool), 2)
            self.trees.append(tree)
            score = score + add

    def _grow(self, bins, grad, hess, rows, depth):
        leaf = lambda at: float(self.rate * grad[at].sum() / (hess[at].sum() + 1))
        best, gain = None, 1e-6
        power = lambda at: grad[at].sum() ** 2 / (hess[at].sum() + 1)
        if depth:
            for f, name in enumerate(self.names):
                for v in range(FEATURES[name] - 1):
                    for kind, side in (("le", bins[:, f] <= v), ("eq", bins[:, f] == v)):
                        a, b = rows & side, rows & ~side
                        if a.any() and b.any() and (g := power(a) + power(b) - power(rows)) > gain:
                            best, gain = (f, v, kind, a, b), g
        if best is None:
            value = leaf(rows)
            return value, np.where(rows, value, 0.0)
        f, v, kind, a, b = best
        left, add_l = self._grow(bins, grad, hess, a, depth - 1)
        right, add_r = self._grow(bins, grad, hess, b, depth - 1)
        return (self.names[f], v, kind, left, right), add_l + add_r

    def _of(self, tree, row) -> float:
        while not isinstance(tree, float):
            name, v, kind, left, right = tree
            x = row[self.names.index(name)]
            tree = left if (x <= v if kind == "le" else x == v) else right
        return tree

    def score(self, row) -> float:
        return self.start + sum(self._of(t, row) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The score of the candidate ``x`` as an expression."""

        def case(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, v, kind, left, right = tree
            return F.when(x[name] <= v if kind == "le" else x[name] == v, case(left)).otherwise(case(right))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + case(t)
        return out


def _lowest(scores: np.ndarray, n: np.ndarray, yes: np.ndarray, precision: float) -> float | None:
    """The lowest score from which on an isotonic fit gives a share of ``precision`` or more, smoothed by one row without the label."""
    blocks: list[list[float]] = []
    for i in np.argsort(scores, kind="stable"):
        blocks.append([scores[i], yes[i], n[i]])
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    good = [b[0] for b in blocks if b[1] >= precision * (b[2] + 1)]
    return min(good) - 1e-9 if good else None


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[Boosted, list[float | None]]:
    """Trees from one half of all documents, and the threshold of each kind (None: nothing is added) from the other."""
    names = list(FEATURES)
    each = found.select("half", F.explode("candidates").alias("x")).select("half", *[F.col(f"x.{k}").alias(k) for k in names], F.col("x.label").cast("long").alias("yes"))
    rows = each.groupBy("half", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("yes").alias("yes")).orderBy("half", *names).collect()  # combinations of bins at most
    bins = np.array([[r[k] for k in names] for r in rows], dtype=np.int64).reshape(-1, len(names))
    half, n, yes = (np.array([float(r[k]) for r in rows]) for k in ("half", "n", "yes"))
    model = Boosted(bins[half == 0], n[half == 0], yes[half == 0])
    scores = np.array([model.score(b) for b in bins.tolist()])
    limits = []
    for kind in range(len(KINDS)):
        own = (half == 1) & (bins[:, 0] == kind)
        limits.append(_lowest(scores[own], n[own], yes[own], precision))
    return model, limits


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and added spans (kind, start, stop) of each row."""
    found = persist(proposals(docs), "pii")
    return _chosen(found, *fit(found, precision))


def _chosen(found: DataFrame, model: Boosted, limits: list[float | None]) -> DataFrame:
    """``found`` with all base spans as ``base`` and the selected candidates as ``added``."""
    named = lambda i: lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    base = F.concat(*[F.transform(F.col(k), named(i)) for i, k in enumerate(KINDS)])

    def chosen(x: Column) -> Column:
        ok = F.lit(False)
        for i, limit in enumerate(limits):
            if limit is not None:
                ok = ok | ((x["kind"] == i) & (model.column(x) >= limit))
        return ok

    added = F.transform(F.filter("free", chosen), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return found.withColumns({"base": base, "added": added})


def listed(spans: Column) -> Column:
    """kind:start:stop of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and all spans of each row."""
    found = find(docs)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id and text of each row, each span (overlapping ones as one) replaced by the first one's [KIND]."""
    model, limits = fit(persist(proposals(docs).select("half", "candidates"), "pii"), precision)
    rows = _chosen(proposals(docs, keep_text=True), model, limits)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))

    def add(acc: Column, x: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.element_at(names, x["kind"] + 1)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], before, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select("doc_id", done.alias("text"))
