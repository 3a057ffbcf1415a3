"""Text scalars as column expressions: tokens, stems, HTML, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, irregular forms, shorthands and suffixes of the lexical index.
STOPWORDS = (
    "a an the and or but if then else for to of in on at by with from up down out is are was were be been being am do does did "
    "doing have has had having i you he she it we they me him her us them my your his its our their this that these those as so "
    "not no nor too very can will just dont should now about into over after before between during again further once here there "
    "when where why how all any both each few more most other some such only own same than s t"
).split()
LEMMAS = {
    "chose": "choose", "chosen": "choose", "made": "make", "built": "build", "wrote": "write", "written": "write", "took": "take",
    "taken": "take", "gave": "give", "given": "give", "went": "go", "gone": "go", "got": "get", "gotten": "get", "kept": "keep",
    "sent": "send", "spent": "spend", "held": "hold", "ran": "run", "came": "come", "brought": "bring", "bought": "buy",
    "thought": "think", "taught": "teach", "caught": "catch", "sold": "sell", "told": "tell", "paid": "pay", "met": "meet",
    "began": "begin", "begun": "begin", "broke": "break", "broken": "break", "spoke": "speak", "spoken": "speak", "drove": "drive",
    "driven": "drive", "grew": "grow", "grown": "grow", "knew": "know", "known": "know", "threw": "throw", "thrown": "throw",
    "understood": "understand", "stood": "stand", "lost": "lose", "won": "win", "hid": "hide", "hidden": "hide", "froze": "freeze",
    "frozen": "freeze", "dealt": "deal", "meant": "mean", "became": "become", "found": "find", "fell": "fall", "fallen": "fall",
}
ALIASES = {
    "postgres": "postgresql", "pg": "postgresql", "mongo": "mongodb", "k8s": "kubernetes", "js": "javascript", "ts": "typescript",
    "py": "python", "tf": "terraform", "repo": "repository", "repos": "repository", "config": "configuration",
    "auth": "authentication", "db": "database", "env": "environment",
}
SUFFIXES = ("ization", "ational", "fulness", "ousness", "iveness", "ation", "ements", "ement", "ments", "ment", "ness", "edly", "ingly", "ing", "ed")
TOKEN = r"[a-z0-9][a-z0-9'_-]*"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
DOUBLES = "bcdfghjkmnpqrtvwxy"  # consonants whose trailing pair is undoubled: all but l, s, z


def _whole_form() -> dict[str, str]:
    """Shorthand, then irregular form, as one lookup."""
    both = {w: LEMMAS.get(to, to) for w, to in ALIASES.items()}
    return {**LEMMAS, **both}


def words(text: Column) -> Column:
    """Lower-case tokens, trimmed of quotes, dashes and underscores, of two characters or more, without stop words."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, r"^['_-]+|['_-]+$", ""))
    return F.filter(trimmed, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


def _steps():
    """The stemmer's steps; each maps a word to a word and applies only to words of over three characters before the first."""
    table = F.create_map(*[F.lit(x) for pair in _whole_form().items() for x in pair])
    n = F.length

    def cut(w: Column, k: int) -> Column:
        return F.substring(w, F.lit(1), n(w) - k)

    return [
        lambda w: F.coalesce(F.try_element_at(table, w), w),
        lambda w: F.when(n(w) <= 3, F.concat(w, F.lit("\0"))).when(w.rlike("(sses|ies)$"), cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w),
        lambda w: F.when(w.endswith("\0"), w).otherwise(F.regexp_replace(w, f"({'|'.join(SUFFIXES)})$", "")),
        lambda w: F.when(~w.endswith("\0") & (n(w) >= 4) & w.rlike(f"([{DOUBLES}])\\1$"), cut(w, 1)).otherwise(w),
        lambda w: F.when((n(w) >= 4) & w.endswith("e") & ~w.endswith("ee"), cut(w, 1)).otherwise(w),
        lambda w: F.when(~w.endswith("\0") & (n(w) > 3) & w.rlike("[^aeiou]y$"), F.concat(cut(w, 1), F.lit("i"))).otherwise(w),
        lambda w: F.rtrim(w, F.lit("\0")),
    ]


def stemmed(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df`` with the stem of column ``word``.

    The steps are lambdas, which bind the word once each: as a chain of projections the optimizer would substitute every step
    into the next (and into a join's null filter), and the expression would grow as a power of the steps.
    """
    return df.withColumn(out, stem_array(F.array(F.col(word)))[0])


def stem_array(array: Column) -> Column:
    for step in _steps():
        array = F.transform(array, step)
    return array


def tokenize(text: Column, stemming: bool = True) -> Column:
    return stem_array(words(text)) if stemming else words(text)


def html_to_text(html: Column) -> Column:
    """Plain text of HTML: comments, scripts and styles go, block ends become line ends, references become characters."""
    r = F.regexp_replace
    out = r(html, r"(?s)<!--.*?-->", " ")
    out = r(out, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = r(out, r"(?i)<(?:br|/p|/div|/h[1-6]|/li)\s*/?>", "\n")
    out = r(out, r"<[^>]+>", " ")
    pieces, found = F.split(out, r"&#[0-9]+;", -1), F.regexp_extract_all(out, F.lit(r"&#([0-9]+);"), F.lit(1))
    code = lambda d: F.decode(F.unhex(F.lpad(F.hex(F.pmod(d.cast("decimal(38,0)"), F.lit(65536)).cast("long")), 4, "0")), "UTF-16BE")
    chars = F.concat(F.transform(found, code), F.array(F.lit("")))
    out = F.when(F.size(found) > 0, F.array_join(F.zip_with(pieces, chars, lambda a, b: F.concat(a, b)), "")).otherwise(out)
    for name, char in ENTITIES.items():  # &amp; last, so that no reference is read twice
        out = r(out, f"(?i){name}", char)
    out = r(r(r(out, r"[ \t]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return r(out, r"^\s+|\s+$", "")


def mostly_printable(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.coalesce(kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)) >= 0.7


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 code units, as 8 hex digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step)), 8, "0"))


def citation(source: Column, start: Column, end: Column) -> Column:
    return F.concat(source, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def snippet(text: Column, terms: Column, width: int = 240) -> Column:
    """The ``width`` characters, from a sixth of it before, where most of ``terms`` (empty ones left out) occur."""
    lower = F.lower(text)

    def places(term: Column) -> Column:
        pieces = F.split(lower, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
        lengths = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n + F.length(term)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"])

    hits = F.array_sort(F.flatten(F.transform(F.filter(terms, lambda t: t != ""), places)))
    counted = F.transform(hits, lambda h: F.struct((-F.size(F.filter(hits, lambda x: (x >= h) & (x < h + width)))).alias("n"), h.alias("h")))
    begin = F.greatest(F.lit(0), F.array_min(counted)["h"] - width // 6)
    end = F.least(F.length(text), begin + width)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = F.concat(F.when(begin > 0, "…").otherwise(""), trim(F.substring(text, begin + 1, end - begin)), F.when(end < F.length(text), "…").otherwise(""))
    plain = F.concat(trim(F.substring(text, F.lit(1), F.lit(width))), F.when(F.length(text) > width, "…").otherwise(""))
    return F.when(F.size(hits) > 0, found).otherwise(plain)


def passage(rank: Column, citation: Column, date: Column, text: Column) -> Column:
    """A numbered passage: "[rank] citation (date)", then the text."""
    dated = F.when(date.isNotNull(), F.concat(F.lit(" ("), date, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), citation, dated, F.lit("\n"), F.regexp_replace(text, r"^\s+|\s+$", ""))


def format_passages(rows: DataFrame) -> DataFrame:
    """qid, passages: the passages of each query (qid, rank, citation, date, text) in the order of their ranks, parted by blank lines."""
    each = rows.select("qid", F.struct("rank", passage(F.col("rank"), F.col("citation"), F.col("date"), F.col("text")).alias("p")).alias("x"))
    return each.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "\n\n").alias("passages"))
