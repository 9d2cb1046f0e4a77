"""Secret scan in DataFrame expressions only: fixed patterns, and a battery of randomness tests on long tokens.

A long token without spaces is a candidate. Its encoding is inferred from its characters (hex, base32, base64), and three
tests ask whether it could be uniform random text in that encoding: a chi-squared test of symbol frequencies (Wilson and
Hilferty's normal form), a runs test of character classes (digit, upper, lower, other), and the serial correlation of
neighbouring symbols. A token is random if none rejects (Bonferroni). As words of natural language change class rarely,
the number of runs also gives a p-value against natural text; these are weighted by length and pass a
Benjamini-Hochberg step over all candidates of the document, so long documents don't give more false finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import id_text, tuned

#: The base patterns, their kinds in order, and the least length of what each must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by encoding; chance that two neighbours differ in class, for uniform symbols.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
CHANGES = {"hex": 0.469, "base32": 0.305, "base64": 0.655}
#: Chance of a class change between neighbours in natural tokens; level of the battery; rate of false discoveries.
TEXT_CHANGE, LEVEL, FALSE_RATE = 0.08, 0.003, 0.001
_SPAN = "struct<start:bigint,end:bigint,rank:int>"


def _spans(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: lengths of what lies between and of the matches, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(F.transform(found, lambda x: F.length(x)).alias("n"), gaps.alias("gap"), F.transform(held, lambda x: F.length(x) >= least).alias("ok"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"))))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to within a few per cent of its value."""
    return F.when(z < 0, F.lit(1.0) - _half(-z)).otherwise(_half(z))


def _half(z: Column) -> Column:
    return F.lit(0.5) * F.exp(-0.717 * z - 0.416 * z * z)


def _tested(token: Column) -> Column:
    """struct(ok: random in its encoding; p: p-value against natural text; n: length)."""
    kind = F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "=+$", ""), "-", "+"), "_", "/")
    text = F.when(kind == "hex", F.lower(body)).otherwise(body)
    pick = lambda table: F.when(kind == "hex", table["hex"]).when(kind == "base32", table["base32"]).otherwise(table["base64"])
    alphabet, change = pick({k: F.lit(v) for k, v in ALPHABETS.items()}), pick({k: F.lit(v) for k, v in CHANGES.items()})
    n, size = F.length(text).cast("double"), F.length(alphabet).cast("double")
    square = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, s: acc + F.pow(n - F.length(F.replace(text, s, F.lit(""))), F.lit(2.0)))
    df = size - 1
    chi = square * size / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    classes = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "A" * 26 + "a" * 26 + "0" * 10 + "++")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double") - 1
    z_runs = (runs - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    z_text = (runs - (n - 1) * TEXT_CHANGE) / F.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE))
    codes = F.transform(F.split(text, ""), lambda c: F.instr(alphabet, c).cast("double"))
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("s", "ss", "xy", "last", "n")))
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["xy"] + a["last"] * x).alias("xy"), x.alias("last"), (a["n"] + 1).alias("n"))
    finish = lambda a: F.coalesce(F.try_divide(a["xy"] / (a["n"] - 1) - F.pow(a["s"] / a["n"], F.lit(2.0)), a["ss"] / a["n"] - F.pow(a["s"] / a["n"], F.lit(2.0))), F.lit(1.0)) * F.sqrt(a["n"])
    z_serial = F.aggregate(codes, zero, add, finish)
    least = F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
    ok = (n >= 16) & (least * 3 >= LEVEL)
    return F.struct(ok.alias("ok"), _tail(z_text).alias("p"), n.alias("n"))


def _random_spans(df: DataFrame) -> DataFrame:
    """Adds the column random: spans of tokens that the battery and the false-discovery step leave."""
    df = df.withColumn("tokens", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("at", _spans(F.col("text"), CANDIDATE, 3))
    df = df.withColumn("tested", F.transform("tokens", _tested))
    mean = F.aggregate("tested", F.lit(0.0), lambda a, t: a + t["n"]) / F.size("tested")
    df = df.withColumn("weighted", F.when(F.size("tested") > 0, F.transform("tested", lambda t: t["p"] * mean / F.greatest(t["n"], F.lit(1.0)))).otherwise(F.array().cast("array<double>")))
    df = df.withColumn("ranked", F.array_sort("weighted"))
    passed = F.filter("ranked", lambda p, k: p <= FALSE_RATE * (k + 1) / F.size("ranked"))
    df = df.withColumn("cut", F.coalesce(F.array_max(passed), F.lit(-1.0)))
    random = F.filter("at", lambda s, k: F.get("tested", k)["ok"] & (F.get("weighted", k) <= F.col("cut")))
    return df.withColumn("random", random).drop("tokens", "at", "tested", "weighted", "ranked", "cut")


def scan_secrets(df: DataFrame) -> DataFrame:
    """Adds base and spans to a table with a text column: arrays of (start, end, rank), by start, then rank in KINDS.

    Positions are code points, ends exclusive. base holds the matches of the three fixed patterns, leftmost and
    non-overlapping for each; spans also those of the method. Null text counts as empty and has none. The table must not
    have columns of the names base, spans, assign, access, hex or random; scan() picks its own columns.
    """
    tuned(df.sparkSession)
    text = F.col("text")
    df = df.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumns({"assign": _spans(text, ASSIGN, 0, 6, 2), "access": _spans(text, ACCESS, 1, 20), "hex": _spans(text, HEX, 2)})
    df = _random_spans(df)
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"), lambda a, b: _order(a, b)))
    return df.withColumn("spans", F.array_sort(F.concat("base", "random"), lambda a, b: _order(a, b))).drop("assign", "access", "hex", "random")


def _order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["rank"] != b["rank"], F.when(a["rank"] < b["rank"], -1).otherwise(1)).otherwise(F.lit(0))


def written(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs with a doc_id."""
    out = scan_secrets(id_text(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(df: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The table with every span of its text replaced by mark; touching and overlapping spans by one. All other columns stay."""
    columns = df.columns
    known = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text"))
    out = scan_secrets(known)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), one(F.try_element_at(acc, F.lit(-1))["start"], F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"])))).otherwise(F.concat(acc, one(s["start"], s["end"])))

    out = out.withColumn("merged", F.aggregate("spans", none, join))
    before = lambda s, k: F.when(k == 0, F.lit(0)).otherwise(F.get("merged", k - 1)["end"])
    parts = F.transform("merged", lambda s, k: F.concat(F.substring(F.col("text"), (before(s, k) + 1).cast("int"), (s["start"] - before(s, k)).cast("int")), F.lit(mark)))
    tail = F.substring(F.col("text"), (F.element_at("merged", -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size("merged") == 0, F.col("row.text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return out.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))
