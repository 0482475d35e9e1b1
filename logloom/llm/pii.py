"""Personal data: fixed forms, and forms found by bootstrapped contextual extraction.

The fixed forms (e-mail, IP and card numbers, phone numbers) are the seeds.  Wider forms
(addresses with or without a domain or with "at" and "dot" written out, runs of digits in
any groups, groups with dots or colons) cut each text into runs and what stands between
them.  A run that holds a seed is a known value, any other a candidate for the kinds that
its digits allow.  The words around a run are its patterns: the two before it, the two
behind it, and one on each side; the start and the end of a text and another run count as
words.  Patterns and values form a graph: a pattern scores by the share of its values that
are known, a value by the patterns that it is seen with, and a value that scores high is a
known one in the next round.  A candidate beside a pattern that scores high is personal
data too, of the kind of its best pattern; seeds always stay.

Only DataFrame expressions.  Each text is read where it lies; what goes through a shuffle
are the occurrences, summed by pattern and value first.  Sums along a text's matches are
taken in blocks, so work grows with the text and not with its square.

Defined results: a null text counts as empty and has no spans; rows with null ids and
repeated rows are treated alike; offsets are code points; an empty table gives an
empty result; further columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import named, scratch, table

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# A match starts where the last one ended or where a run begins, so that a long run is
# read once; what matches is the same as without these starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Runs that may be an identifier.
_AT, _DOT = r"(?:@|\x20?[\[(]at[\])]\x20?)", r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
_ADDRESS = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++(?:{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)*+|\x20at\x20[\p{{L}}\p{{N}}-]++(?:\x20dot\x20[\p{{L}}\p{{N}}-]++)++)"
_GROUPS = r"(?<![\p{L}\p{N}.:])(?:[0-9]++(?:\.[0-9]++){3,}+|[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,}+)(?![\p{L}\p{N}])"
_DIGITS = r"(?<![\p{L}\p{N}])(?=[+(]*+(?:[0-9][\x20().\-/]{0,3}){6}[0-9])[+(]*+[0-9]++(?:[\x20().\-/]{1,3}+[0-9]++)*+(?![\p{L}\p{N}])"
RUN = f"{_ADDRESS}|{_GROUPS}|{_DIGITS}"

_WORD = r"[\p{L}\p{N}]"
_BEFORE = rf"(?<!{_WORD})(?:({_WORD}++)[^\p{{L}}\p{{N}}]++)?({_WORD}++)[^\p{{L}}\p{{N}}]*+\z"
_BEHIND = rf"\A[^\p{{L}}\p{{N}}]*+({_WORD}++)(?:[^\p{{L}}\p{{N}}]++({_WORD}++))?"

ROUNDS, SUPPORT, ACCEPT = 3, 3, 0.8
#: Matches to a block of a text's matches.
BLOCK = 64

_RUNS = "array<struct<kind:int,start:int,end:int,value:string,known:boolean,cues:array<string>>>"
_PLAIN = "array<struct<kind:int,start:int,end:int>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_blocks(values: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size``; none for an empty one."""
    cut = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(size)), lambda first: F.slice(values, first, F.lit(size)))
    return F.when(F.size(values) > 0, cut).otherwise(F.array())


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each integer what ``join`` (a sum, a maximum) makes of all up to it, from 0 on.

    A fold that appends to an array copies it each time, so it only runs over blocks; what
    the blocks come to is run over in the same way.
    """

    def fold(part: Column) -> Column:
        step = lambda acc, x: _let(join(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), _none("array<int>").alias("out")), step, lambda acc: acc["out"])

    if levels == 1:
        return fold(values)

    def whole(blocks: Column) -> Column:
        upto = running(F.transform(blocks, lambda b: F.element_at(b, -1)), join, levels - 1)
        before = lambda ends, i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        return _let(upto, lambda ends: F.flatten(F.transform(blocks, lambda own, i: _let(before(ends, i), lambda at: F.transform(own, lambda x: join(at, x))))))

    return _let(values, lambda v: _let(F.transform(_in_blocks(v), fold), whole))


def _pieces(text: Column, pattern: str) -> Column:
    """All matches and what stands between them."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))


def _placed(pieces: Column) -> Column:
    """The matches with their places and what stands on both sides: an array of (start, end, value, before, behind)."""
    gap = lambda i: F.get(pieces["gaps"], i)
    sizes = F.transform(pieces["values"], lambda v, i: F.char_length(v) + F.char_length(gap(i)))

    def spans(ends: Column) -> Column:
        end = lambda i: F.get(ends, i)
        return F.transform(pieces["values"], lambda v, i: F.struct((end(i) - F.char_length(v)).alias("start"), end(i).alias("end"), v.alias("value"), gap(i).alias("before"), gap(i + 1).alias("behind")))

    return _let(running(sizes, lambda a, b: a + b), spans)


def located(text: Column, pattern: str) -> Column:
    return _let(_pieces(text, pattern), _placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


_FORMS = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@"))),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]")),
}


def _number_of_kind(spans: Column, i: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("bigint")


def fixed(text: Column) -> Column:
    """Spans of the fixed forms: an array of (kind, start, end, value), kinds by number, by kind and start."""
    nothing = F.struct(F.expr("cast(array() as array<string>)").alias("values"), F.expr("cast(array() as array<string>)").alias("gaps"))
    pieces = [F.when(may(text), _pieces(text, pattern)).otherwise(nothing) for pattern, may in _FORMS.values()]
    # Built once for all kinds, so that the plan stays small.
    placed = F.transform(F.array(*pieces), lambda own, i: F.transform(_placed(own), lambda x: F.struct(i.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
    return F.filter(F.flatten(placed), _any_valid)


def _any_valid(x: Column) -> Column:
    """Whether a match is valid for its kind."""
    out = F.lit(True)
    for i, kind in reversed(list(enumerate(KINDS))):
        out = F.when(x["kind"] == i, _valid(kind, x["value"])).otherwise(out)
    return out


def _holds(value: Column) -> Column:
    """The kinds of the fixed forms within a run."""
    has = lambda kind: F.exists(F.regexp_extract_all(value, F.lit(_FORMS[kind][0]), F.lit(0)), lambda v: _valid(kind, v))
    return F.array_compact(F.array(*[F.when(_FORMS[kind][1](value) & has(kind), i) for i, kind in enumerate(KINDS)]))


def _may_be(value: Column) -> Column:
    """The kinds that a run without a fixed form may be of."""
    digits = F.char_length(_digits(value))
    address = value.rlike(r"@|[\[(]at[\])]|\x20at\x20")
    groups = value.rlike(r"^[0-9]+(?:\.[0-9]+){3,}$|^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$")
    return F.array_compact(F.array(F.when(address, 0), F.when(~address & groups, 1), F.when(~address & digits.between(12, 24), 2), F.when(~address & ~groups & digits.between(7, 15), 3)))


def _cues(run: Column, first: Column, last: Column) -> Column:
    """The patterns of a run, digits as 0 and letters lowered; a text's start and end and a neighbour count as words."""
    word = lambda gap, pattern, i: F.regexp_replace(F.lower(F.regexp_extract(gap, pattern, i)), "[0-9]+", "0")
    found = F.array(word(run["before"], _BEFORE, 1), word(run["before"], _BEFORE, 2), word(run["behind"], _BEHIND, 1), word(run["behind"], _BEHIND, 2))

    def patterns(w: Column) -> Column:
        start, end = F.when(first, "^").otherwise("#"), F.when(last, "$").otherwise("#")
        b1, e1 = F.when(w[1] == "", start).otherwise(w[1]), F.when(w[2] == "", end).otherwise(w[2])
        b2, e2 = F.when(w[0] == "", start).otherwise(w[0]), F.when(w[3] == "", end).otherwise(w[3])
        # A pattern needs a word; the start of a text alone is none.
        return F.array_compact(F.array(
            F.when(w[1] != "", F.concat(b2, F.lit(" "), b1, F.lit(" _"))),
            F.when((w[1] != "") | (w[2] != ""), F.concat(b1, F.lit(" _ "), e1)),
            F.when(w[2] != "", F.concat(F.lit("_ "), e1, F.lit(" "), e2)),
        ))

    return _let(found, patterns)


def runs(text: Column) -> Column:
    """Known values and candidates with their patterns: an array of (kind, start, end, value, known, cues)."""

    def judged(found: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            def row(holds: Column) -> Column:
                known = F.size(holds) > 0
                kinds = F.when(known, holds).otherwise(_may_be(x["value"]))
                cues = _cues(x, i == 0, i == F.size(found) - 1)
                return _let(cues, lambda c: F.transform(kinds, lambda k: F.struct(k.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), known.alias("known"), c.alias("cues"))))

            return _let(_holds(x["value"]), row)

        return F.flatten(F.transform(found, of))

    may = text.rlike(r"@|[0-9][^\p{L}]*[0-9]|[\[(]at[\])]|\x20at\x20[\p{L}\p{N}-]++\x20dot\x20|[0-9A-Fa-f]:[0-9A-Fa-f]")
    return F.when(may, _let(located(text, RUN), judged)).otherwise(_none(_RUNS))


def occurrences(docs: DataFrame, *keep: Column) -> DataFrame:
    """For each row ``doc_id``, ``key`` (a hash of the text), the columns ``keep``, and the arrays ``seeds`` and ``runs``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *keep)
    others = [c for c in rows.columns if c not in ("doc_id", "__text")]
    return rows.select("doc_id", F.xxhash64("__text").alias("key"), *map(named, others), fixed(F.col("__text")).alias("seeds"), runs(F.col("__text")).alias("runs"))


def patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``kind``, ``cue`` and ``trust`` of the patterns that find personal data.

    A pattern needs ``support`` known values and at least ``accept`` of its values known,
    where a value counts by what it scores; values that score ``accept`` are known ones of
    the next round.
    """
    edges = found.select(F.explode("runs").alias("x")).select("x.kind", F.explode("x.cues").alias("cue"), "x.value", "x.known")
    edges = edges.groupBy("kind", "cue", "value").agg(F.max("known").alias("known"))
    # What is known anywhere is known everywhere.
    known = edges.where("known").select("kind", "value").distinct().withColumn("seed", F.lit(1.0))
    edges = table(edges.drop("known").join(known, ["kind", "value"], "left").withColumn("seed", F.coalesce("seed", F.lit(0.0))), "pii-edges")
    values = edges.withColumn("score", F.col("seed"))
    for turn in range(rounds):
        good = values.groupBy("kind", "cue").agg((F.sum("score") / F.count("*")).alias("trust"), F.count_if(F.col("score") >= accept).alias("seen"))
        good = good.where((F.col("seen") >= support) & (F.col("trust") >= accept)).select("kind", "cue", "trust")
        if turn == rounds - 1:
            break
        # A value is as sure as the chance that not all its patterns err.
        sure = edges.join(good, ["kind", "cue"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("sure"))
        values = edges.join(sure, ["kind", "value"], "left").withColumn("score", F.greatest("seed", F.coalesce("sure", F.lit(0.0))))
    return table(good, "pii-patterns")


def discover(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, ``key``, ``kind``, ``start``, ``end`` of what patterns find beyond the seeds.

    A run that patterns of several kinds claim is of the kind that the most trusted one has.
    """
    good = patterns(found, rounds, support, accept)
    unknown = F.filter("runs", lambda x: ~x["known"])
    rows = found.where(F.size(unknown) > 0).select("doc_id", "key", F.explode(unknown).alias("x")).select("doc_id", "key", "x.kind", "x.start", "x.end", F.explode("x.cues").alias("cue"))
    best = F.max_by("kind", F.struct("trust", -F.col("kind")))
    return rows.join(good, ["kind", "cue"]).groupBy("doc_id", "key", "start", "end").agg(best.alias("kind"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _with_extra(found: DataFrame) -> DataFrame:
    """``found`` with ``extra``, the discovered spans of each row; equal rows find equal spans."""
    with scratch(found.sparkSession) as keep:
        extra = discover(found).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("extra"))
        extra = keep(table(extra.withColumnsRenamed({"doc_id": "__id", "key": "__key"}), "pii-extra"))
    rows = found.join(extra, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return rows.withColumn("extra", F.coalesce("extra", _none(_PLAIN))).drop("__id", "__key")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each kind, a digest of the fixed spans, and all ``spans``."""
    rows = _with_extra(table(occurrences(docs), "pii"))
    every = F.sort_array(F.concat(_bare(F.col("seeds")), F.col("extra")))
    return rows.select(
        "doc_id",
        *[_number_of_kind(F.col("seeds"), i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("seeds")).cast("binary"), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.size(every).cast("bigint").alias("n_spans"),
        F.size("extra").cast("bigint").alias("n_discovered"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted spans (start, end, kind) as its kind in angle brackets; spans that overlap become one.

    Places are found in parts of the text that hold a block of spans, not from its start.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    part = lambda t, a, b: F.substr(t, a + 1, b - a)

    def cut(reached: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.get(reached, i - 1)).otherwise(0)
        # From where the last span ended to where this one starts; within another span there is nothing.
        gaps = F.transform(spans, lambda x, i: F.struct(upto(i).alias("from"), x["start"].alias("to"), x["kind"].alias("kind")))
        gaps = F.filter(gaps, lambda g: g["to"] >= g["from"])

        def block(own: Column) -> Column:
            base, stop = F.element_at(own, 1)["from"], F.element_at(own, -1)["to"]
            pieces = lambda t: F.array_join(F.transform(own, lambda g: F.concat(part(t, g["from"] - base, g["to"] - base), F.element_at(names, g["kind"] + 1))), "")
            return _let(part(text, base, stop), pieces)

        rest = F.substr(text, F.element_at(reached, -1) + 1, F.char_length(text))
        return F.concat(_let(gaps, lambda own: F.array_join(F.transform(_in_blocks(own, 4 * BLOCK), block), "")), rest)

    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, _let(ends, cut)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; spans that overlap become one."""
    whole = F.struct(*map(named, docs.columns)).alias("__row")
    rows = _with_extra(table(occurrences(docs, whole), "pii"))
    spans = F.concat(_bare(F.col("seeds")), F.col("extra"))
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.select("__row", by_start.alias("__spans"))
    rows = rows.withColumn("__text", replaced(F.col("__row.text").cast("string"), F.col("__spans")))
    own = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("bigint")}
    return rows.select(*[own[c].alias(c) if c in own else F.col("__row").getField(c).alias(c) for c in docs.columns])
