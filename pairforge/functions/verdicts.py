"""Reading a judge's reply: tokens of a line run through a table of states, as Spark expressions; and the same table in Python for a client that retries.

A line is cut into tokens (tags, runs of letters and digits, single signs), a token has a kind, and MOVES says how a kind leads from a state to the next. Where a line
ends says what it is; a head that is reached on the way (a choice, a confidence) counts whatever follows it. The readings of all lines then decide:

1. the whole reply is `x n` or a tagged pair;
2. lines after the last announcement of a final answer hold one compact verdict;
3. one distinct verdict is left of: lines that are `x n`, pairs on a line or on two, one choice with one confidence, a bare letter first with a labelled confidence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words and signs of the grammar and their kinds. x is a choice, n a number; see KIND_RULES for the other tokens.
WORDS = {
    "a": "x", "b": "x", "c": "x", "d": "x", "choice": "choice", "confidence": "sure", "answer": "answer", "final": "final", "verdict": "ruling", "judgment": "ruling", "judgement": "ruling",
    "<choice>": "<choice>", "</choice>": "closed", "<choise>": "<misspelt>", "<confidence>": "<sure>", "</confidence>": "closed",
    "**": "bold", "-": "dash", "*": "star", ":": "colon", "=": "equals", ".": "dot", "(": "open", ")": "close", '"': "quote", "'": "quote", "`": "quote",
}
#: Letter and digit in one; a choice or a number with a sign after it, so that it ends there; numbers.
KIND_RULES = (("^[abcd][1-5]$", "xn"), ("^[abcd][+-]", "x-"), ("^[+-]?[0-9]+$", "n"), ("^[+-]?[0-9]+[+-]", "n-"))
TOKEN = r"</?[a-z]+>|\*\*|[\w+-]+|\S"

#: state: kinds that lead on, and where to. Kinds that aren't named lead nowhere.
MOVES = {
    "start": {"x": "letter", "xn": "compact", "choice": "choice key", "sure": "label key", "answer": "answer key", "final": "final", "<choice>": "in choice tag", "<misspelt>": "in odd tag", "<sure>": "in sure tag", "dash": "bullet", "star": "bullet", "bold": "bold", "open": "paren"},
    "bullet": {"choice": "choice key", "sure": "sure key", "<choice>": "in odd tag", "<misspelt>": "in odd tag", "<sure>": "in listed tag", "bold": "bold", "open": "paren"},
    "bold": {"choice": "choice key", "sure": "sure key", "final": "bold final", "open": "paren"},
    "letter": {"n": "plain", "dot": "bare", "close": "bare", "colon": "bare"},
    "choice key": {"colon": "choice value", "equals": "choice value"},
    "choice value": {"bold": "choice value", "x": "choice", "x-": "choice head", "quote": "quoted", "star": "quoted"},
    "quoted": {"quote": "quoted", "star": "quoted", "bold": "quoted", "x": "choice head", "x-": "choice head"},
    "choice": {"bold": "choice", "dash": "second key", "star": "second key", "sure": "second label"},
    "second key": {"bold": "second key", "sure": "second label"},
    "second label": {"colon": "second value", "equals": "second value"},
    "second value": {"bold": "second value", "n": "pair"},
    "pair": {"bold": "pair"},
    "label key": {"colon": "label value", "equals": "label value", "bold": "loose value", "n": "loose sure", "n-": "sure head", "close": "loose key"},
    "label value": {"bold": "sure value", "n": "label", "n-": "label head"},
    "label": {"bold": "label"},
    "sure key": {"colon": "sure value", "equals": "sure value", "bold": "loose value", "n": "loose sure", "n-": "sure head", "close": "loose key"},
    "sure value": {"bold": "sure value", "n": "sure", "n-": "sure head"},
    "sure": {"bold": "sure"},
    "paren": {"sure": "loose key"},
    "loose key": {"close": "loose key", "colon": "loose value", "equals": "loose value", "bold": "loose value", "n": "loose sure", "n-": "sure head"},
    "loose value": {"bold": "loose value", "n": "loose sure", "n-": "sure head"},
    "answer key": {"colon": "answer value", "equals": "answer value"},
    "answer value": {"x": "answer letter"},
    "answer letter": {"n": "pair"},
    "final": {"answer": "final answer", "ruling": "announced"},
    "bold final": {"answer": "announced", "ruling": "announced"},
    "final answer": {"bold": "announced", "colon": "announced answer", "equals": "answer value"},
    "announced": {"bold": "announced", "colon": "announcement"},
    "announced answer": {"x": "answer letter"},
    "in choice tag": {"x": "tagged choice", "x-": "choice head"},
    "in odd tag": {"x": "choice head", "x-": "choice head"},
    "tagged choice": {"closed": "tagged choice", "<sure>": "second tag"},
    "second tag": {"n": "tagged pair"},
    "tagged pair": {"closed": "tagged pair"},
    "in sure tag": {"n": "tagged sure", "n-": "sure head"},
    "in listed tag": {"n": "sure head", "n-": "sure head"},
    "tagged sure": {"closed": "tagged sure"},
}
#: States that make a head of the line, and its kind.
HEADS = {
    "choice": "choice", "tagged choice": "choice", "choice head": "choice",
    "label": "label", "label head": "label", "sure": "sure", "loose sure": "sure", "tagged sure": "sure", "sure head": "sure",
}
WHOLE = ("plain", "tagged pair")
PAIRS = ("plain", "pair", "tagged pair")
ANNOUNCED = ("announced", "final answer", "announced answer", "announcement")
BARE = ("letter", "bare")
#: A choice on one line and a confidence on the next are a pair.
ACROSS = {"choice": ("label", "sure"), "tagged choice": ("tagged sure",)}
#: More tokens than any whole verdict, and any line that is more than a head, can have.
MOST_WHOLE, MOST_LINE = 8, 40

Verdict = tuple[str, int]
Reading = tuple[str, str, str, str | None]


# -- in Python ---------------------------------------------------------------------------------------------------------


def _kind(token: str) -> str:
    return WORDS.get(token) or next((kind for rule, kind in KIND_RULES if re.search(rule, token)), "other")


def _run(text: str, most: int) -> Reading:
    """Last state, choice, number and head of the tokens of a line."""
    state, x, n, head = "start", "", "", None
    tokens = re.findall(TOKEN, text)
    for token in tokens[:most]:
        kind = _kind(token)
        state = MOVES.get(state, {}).get(kind, "nowhere")
        if state != "nowhere":
            x = token[0] if kind in ("x", "x-", "xn") else x
            n = re.match("[+-]?[0-9]+", token)[0] if kind in ("n", "n-") else token[1] if kind == "xn" else n
            head = head or HEADS.get(state)
    return "nowhere" if len(tokens) > most else state, x, n, head


def _span(text: str) -> str:
    text = text.strip()
    for k in (3, 2, 1):
        ticks = "`" * k
        if len(text) >= 2 * k and text.startswith(ticks) and text.endswith(ticks):
            return text[k : len(text) - k].strip()
    return text


def _sure(number: str) -> int:
    digits = number.lstrip("+-").lstrip("0")
    return 1 if number.startswith("-") or not digits else 5 if len(digits) > 1 else min(5, int(digits))


def read_verdict(text: str | None) -> Verdict | None:
    """(choice, confidence 1..5), or None unless exactly one reading is left. Nulls and blank texts have none; lines may be of any length and number."""
    body = re.sub(r"(<[a-z]+>)\s+", r"\1", _span((text or "").lower()))
    state, x, n, _ = _run(body, MOST_WHOLE)
    if state in WHOLE:
        return x, _sure(n)
    lines = [line.strip() for line in re.split(r"\r\n|\n|\r", body)]
    spans = [_span(line) for line in lines]
    read = [_run(span, MOST_LINE) for span in spans]
    clear = [r if s == t else ("nowhere", "", "", None) for r, s, t in zip(read, spans, lines, strict=True)]
    marks = [k for k, r in enumerate(clear) if r[0] in ANNOUNCED]
    if marks:
        last = {(r[1], _sure(r[2])) for r in clear[marks[-1] + 1 :] if r[0] == "compact" or r[0] == "plain" and re.fullmatch("[1-5]", r[2])}
        if len(last) == 1:
            return last.pop()
    found = {(r[1], _sure(r[2])) for r in read if r[0] == "plain"} | {(r[1], _sure(r[2])) for r in clear if r[0] in PAIRS}
    found |= {(a[1], _sure(b[2])) for a, b in zip(clear[:-1], clear[1:], strict=True) if b[0] in ACROSS.get(a[0], ())}
    choices, sure = {r[1] for r in clear if r[3] == "choice"}, {_sure(r[2]) for r in clear if r[3] in ("sure", "label")}
    if len(choices) == len(sure) == 1:
        found.add((choices.pop(), sure.pop()))
    first = next((r for r, t in zip(read, lines, strict=True) if t), ("nowhere", "", "", None))
    label = next((r for r in clear if r[3] == "label"), None)
    if first[0] in BARE and label:
        found.add((first[1], _sure(label[2])))
    return found.pop() if len(found) == 1 else None


# -- as expressions ----------------------------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


_BLANK = " \t\n\r\x0b\x0c"


def strip_code_span(text: Column) -> Column:
    """Trimmed, and without one pair of matching back-ticks, one to three, around the whole."""

    def inner(t: Column) -> Column:
        out = F
        for k in (3, 2, 1):
            ticks = "`" * k
            out = out.when((F.length(t) >= 2 * k) & t.startswith(ticks) & t.endswith(ticks), F.btrim(F.substring(t, F.lit(k + 1), F.length(t) - 2 * k), F.lit(_BLANK)))
        return out.otherwise(t)

    return _let(F.btrim(text, F.lit(_BLANK)), inner)


def _kinds(token: Column) -> Column:
    other = F
    for rule, kind in KIND_RULES:
        other = other.when(token.rlike(rule), kind)
    return F.coalesce(F.try_element_at(_table(WORDS), token), other.otherwise("other"))


def _reading(text: Column, most: int) -> Column:
    """struct(s, x, n, h): last state, choice, number and head of a line's tokens."""
    tokens = F.slice(F.regexp_extract_all(text, F.lit(f"((?U){TOKEN})"), F.lit(1)), 1, most + 1)
    moves, heads = _table({f"{state}|{kind}": to for state, row in MOVES.items() for kind, to in row.items()}), _table(HEADS)

    def step(now: Column, token: Column) -> Column:
        def go(kind: Column) -> Column:
            def put(s: Column) -> Column:
                live = s != "nowhere"
                x = F.when(live & kind.isin("x", "x-", "xn"), F.substring(token, 1, 1)).otherwise(now["x"])
                number = F.when(live & kind.isin("n", "n-"), F.regexp_extract(token, "^[+-]?[0-9]+", 0)).when(live & (kind == "xn"), F.substring(token, 2, 1)).otherwise(now["n"])
                return F.struct(s.alias("s"), x.alias("x"), number.alias("n"), F.coalesce(now["h"], F.try_element_at(heads, s)).alias("h"))

            return _let(F.coalesce(F.try_element_at(moves, F.concat_ws("|", now["s"], kind)), F.lit("nowhere")), put)

        return _let(_kinds(token), go)

    begin = F.struct(F.lit("start").alias("s"), F.lit("").alias("x"), F.lit("").alias("n"), F.lit(None).cast("string").alias("h"))
    found = _let(tokens, lambda t: F.struct(F.size(t).alias("size"), F.aggregate(F.slice(t, 1, most), begin, step).alias("r")))
    return _let(found, lambda f: F.struct(F.when(f["size"] > most, "nowhere").otherwise(f["r"]["s"]).alias("s"), f["r"]["x"].alias("x"), f["r"]["n"].alias("n"), f["r"]["h"].alias("h")))


def _clamped(number: Column) -> Column:
    digits = F.regexp_replace(number, "^[+-]?0*", "")
    return F.when(number.startswith("-") | (digits == ""), 1).when(F.length(digits) > 1, 5).otherwise(F.least(digits.try_cast("int"), F.lit(5)))


def _verdict(x: Column, n: Column) -> Column:
    return F.struct(x.alias("choice"), _clamped(n).alias("confidence"))


def _of(r: Column) -> Column:
    return _verdict(r["x"], r["n"])


_NONE = "struct<choice:string,confidence:int>"


def _body(text: Column) -> Column:
    return F.regexp_replace(strip_code_span(F.lower(F.coalesce(text, F.lit("")))), r"(<[a-z]+>)\s+", "$1")


def _whole(body: Column, otherwise: Column) -> Column:
    return _let(_reading(body, MOST_WHOLE), lambda r: F.when(r["s"].isin(*WHOLE), _of(r)).otherwise(otherwise))


def strict_verdict(text: Column) -> tuple[Column, Column]:
    """(choice, confidence 1..5) of a reply that as a whole is `x n` or a tagged pair; else nulls. Numbers of any length are clamped."""
    found = _whole(_body(text), F.lit(None).cast(_NONE))
    return found["choice"], found["confidence"]


def _decided(lines: Column) -> Column:
    """The verdict of the readings (s, x, n, h, clear, blank) of all lines."""
    clear = F.filter(lines, lambda r: r["clear"])
    within = lambda rows, *states: F.filter(rows, lambda r: r["s"].isin(*states))
    mark = F.array_max(F.transform(lines, lambda r, k: F.when(r["clear"] & r["s"].isin(*ANNOUNCED), k)))
    tail = F.filter(F.slice(lines, mark + 2, F.size(lines)), lambda r: r["clear"] & ((r["s"] == "compact") | (r["s"] == "plain") & r["n"].rlike("^[1-5]$")))
    last = F.array_distinct(F.transform(F.when(mark.isNull(), F.slice(lines, 1, 0)).otherwise(tail), _of))
    plain = F.transform(F.filter(lines, lambda r: r["s"] == "plain"), _of)
    pairs = F.transform(within(clear, *PAIRS), _of)
    across = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.when(a["clear"] & b["clear"] & _follows(a["s"], b["s"]), _verdict(a["x"], b["n"])))
    choices = F.array_distinct(F.transform(F.filter(clear, lambda r: r["h"] == "choice"), lambda r: r["x"]))
    sure = F.array_distinct(F.transform(F.filter(clear, lambda r: r["h"].isin("sure", "label")), lambda r: _clamped(r["n"])))
    heads = _let(F.struct(choices.alias("c"), sure.alias("n")), lambda h: F.when((F.size(h["c"]) == 1) & (F.size(h["n"]) == 1), F.struct(F.get(h["c"], F.lit(0)).alias("choice"), F.get(h["n"], F.lit(0)).alias("confidence"))))
    first = F.get(F.filter(lines, lambda r: ~r["blank"]), F.lit(0))
    label = F.get(F.filter(clear, lambda r: r["h"] == "label"), F.lit(0))
    bare = F.when(first["s"].isin(*BARE) & label.isNotNull(), _verdict(first["x"], label["n"]))
    found = F.array_distinct(F.filter(F.concat(plain, pairs, across, F.array(heads, bare)), lambda v: v.isNotNull()))
    only = lambda rows, otherwise: _let(rows, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(otherwise))
    return only(last, only(found, F.lit(None).cast(_NONE)))


def _follows(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for first, second in ACROSS.items():
        out = out | (a == first) & b.isin(*second)
    return out


def full_verdict(text: Column) -> Column:
    """struct(choice, confidence 1..5) of a reply, null unless exactly one reading is left; see read_verdict."""

    def line(raw: Column) -> Column:
        def put(t: Column) -> Column:
            return _let(strip_code_span(t), lambda z: _let(_reading(z, MOST_LINE), lambda r: F.struct(r["s"].alias("s"), r["x"].alias("x"), r["n"].alias("n"), r["h"].alias("h"), (z == t).alias("clear"), (t == "").alias("blank"))))

        return _let(F.btrim(raw, F.lit(_BLANK)), put)

    return _let(_body(text), lambda body: _whole(body, _let(F.transform(F.split(body, r"\r\n|\n|\r"), line), _decided)))
