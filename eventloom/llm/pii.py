"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

**Seeds** are spans of fixed shapes (email, ip, card, phone). Matches and the gaps between them come from the same
pattern by ``regexp_extract_all`` and ``split``; running sums of their lengths are the places. The patterns are written
so that the regex engine needs no recursion and linear time on long runs.

**Bootstrapping.** A *pattern* is what stands left of a span (a word, with the word before it if it is only ``=`` or ``:``),
or that word and the one right of the span. An *instance* is a base span with all of its words, or a token that looks like an identifier (it
holds a digit or ``@``) and touches no base span. A token that a span is part of stands for its first span. Instances
that look like keys (:data:`KEY`) seed a fifth kind, ``secret``, but their shape alone makes no span. The corpus gives a
graph of patterns and instances with counts. In each round

1. a pattern's score for a kind is the mean confidence of what stands there: 1 for seeds and accepted instances of
   the kind, the mean score of its patterns for an open instance, 0 for anything else;
2. patterns of at least ``LEAST_SCORE`` with ``LEAST_SEEDS`` different seeds or accepted instances are accepted;
3. open instances of accepted patterns are accepted, and so induce further patterns.

Rounds go on until nothing more is accepted. Then all unseen instances in accepted patterns are spans; those that
touch a base span are dropped.

Only counts are shuffled. Patterns are joined by a shuffle unless counted to be few.

Edge cases: null and empty texts have no spans; spans of one kind never overlap; places count code points; null ids and
repeated rows are kept as they are; equal scores go to the alphabetically last kind; an empty table gives no rows. Texts
are used whole; further columns, whatever their names, pass through :func:`redact` and are ignored by :func:`report`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .jaccard import small

LEAST_SEEDS = 5
#: Up to this many patterns are looked for before words become rows.
MOST_PATTERNS = 2000
#: Up to this many first words of accepted patterns are looked for in a text before it is cut into tokens.
MOST_FIRSTS = 100
LEAST_SCORE = 0.8
#: The shapes, in the order of their kinds, as possessive patterns that match the same strings.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(SHAPES)
#: Characters of base spans are written in a private range of their kind while tokens are cut, so a span is one token.
_PRIVATE = 0xE100
_ASCII = "".join(map(chr, range(0x20, 0x7F)))
_MARKS = ["".join(chr(_PRIVATE + 0x100 * i + ord(c)) for c in _ASCII) for i in range(len(KINDS))]
_ANY_MARK = f"{_MARKS[0][0]}-{_MARKS[-1][-1]}"
_MARKED = "|".join(f"[{m[0]}-{m[-1]}]++" for m in _MARKS)
_SIGN = r"[=:]++"
_LEFT = rf"\S++\s++{_SIGN}(?=\s)|\S++"
_TOKEN = rf"(?<!\S)({_LEFT})(?=(\s++)((?=[^\s0-9@{_ANY_MARK}]*+[0-9@{_ANY_MARK}])\S++)(?:\s++(\S++))?)"
_LEADING = r"^[(\[<{\"'`*#$%&]+"
_TRAILING = r"[)\]>}\"'`*#$%&.,;:!?]+$"
SECRET = "secret"
#: What a key looks like: long, of letters and digits.
KEY = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}$"
_SPANS = "array<struct<start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits fulfils the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _keeps(kind: str):
    """``_valid`` of one kind as a one-argument function (a second argument would be taken for an index)."""
    return lambda m: _valid(kind, m)


_RUN = 256


def _places(matches: Column, gaps: Column, keep) -> Column:
    """The spans of those matches that ``keep``; ``gaps[i]`` stands before ``matches[i]``.

    Arrays grow within runs of matches only, so that a text with very many does not take time with their square.
    """
    sizes = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
    runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _RUN).cast("int"))
    totals = F.transform(runs, lambda r: F.aggregate(F.slice(sizes, r * _RUN + 1, _RUN), F.lit(0), lambda s, x: s + x))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def step(s: Column, i: Column) -> Column:
        m = F.get(matches, i)
        start = s["at"] + F.length(F.get(gaps, i))
        end = start + F.length(m)
        return F.struct(end.alias("at"), F.when(keep(m), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    def run(begin: Column, r: Column) -> Column:
        last = F.least((r + 1) * _RUN, F.size(matches)) - 1
        first = F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.sequence(r * _RUN, last), first, step, lambda s: s["out"])

    found = F.flatten(F.transform(F.slice(starts, 1, F.size(starts) - 1), run))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_SPANS))


def seeds(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array of (start, end) for each kind, named ``pii_<kind>``; empty for null texts."""
    text = F.col(text_col)
    hints = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.contains("."), "card": F.lit(True)}
    found = df.select("*", *[F.when(hints[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"_m_{k}") for k, p in SHAPES.items()])
    any_ = {k: F.coalesce(F.exists(f"_m_{k}", _keeps(k)), F.lit(False)) for k in KINDS}
    found = found.select("*", *[F.when(any_[k], F.split(text, p, -1)).alias(f"_g_{k}") for k, p in SHAPES.items()])
    spans = [F.when(F.col(f"_g_{k}").isNotNull(), _places(F.col(f"_m_{k}"), F.col(f"_g_{k}"), _keeps(k))).otherwise(F.array().cast(_SPANS)).alias(f"pii_{k}") for k in KINDS]
    return found.select(*[c for c in df.columns if not c.startswith("pii_")], *spans)


def _marked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the characters of base spans replaced by private ones of their kind; all places stay."""
    found = seeds(df, text_col)
    base = [F.transform(f"pii_{k}", _back_first(i)) for i, k in enumerate(KINDS)]
    found = found.select(*df.columns, F.sort_array(F.concat(*base)).alias("_base"))
    text = F.regexp_replace(text_col, f"[{_ANY_MARK}]", "\ufffd")

    def step(s: Column, x: Column) -> Column:
        end, piece = -x["back"], F.substring(text_col, F.greatest(s["at"], x["start"]) + 1, -x["back"] - F.greatest(s["at"], x["start"]))
        gap = F.when(x["start"] > s["at"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).otherwise("")
        kind = F.when(x["start"] >= s["at"], x["number"]).otherwise(s["number"])  # what overlaps a span continues it
        mark = F.translate(piece, _ASCII, _MARKS[-1])
        for i in range(len(KINDS) - 1):
            mark = F.when(kind == i, F.translate(piece, _ASCII, _MARKS[i])).otherwise(mark)
        new = F.struct(end.alias("at"), kind.alias("number"), F.concat(s["out"], F.array(F.concat(gap, mark))).alias("out"))
        return F.when(end > s["at"], new).otherwise(s)

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("number"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("_base", first, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, F.when(F.size("_base") > 0, whole).otherwise(text)).select(df.columns)


def _back_first(number: int):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(number).alias("number"))


def _seed(token: Column) -> Column:
    """The kind of the first base span in a token of a marked text, or null."""
    point = F.ascii(F.regexp_extract(token, f"[{_ANY_MARK}]", 0))
    return F.when(point > 0, F.get(F.array(*map(F.lit, KINDS)), ((point - _PRIVATE) / 0x100).cast("int")))


def _trimmed(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, _LEADING, ""), _TRAILING, "")


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` (marked) with ``left, both, token, start``: a row for each identifier-like token that follows a word."""
    text = F.col(text_col)
    ready = df.select("*", *[F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(i)).alias(c) for i, c in enumerate(("_l", "_w", "_t", "_r"), 1)], F.split(text, _TOKEN, -1).alias("_g"))
    ready = ready.withColumn("_p", _places(F.col("_l"), F.col("_g"), lambda m: F.lit(True)))
    rows = ready.select(*df.columns, F.explode(F.arrays_zip("_l", "_w", "_t", "_r", "_p")).alias("c"))
    raw = F.col("c._t")
    start = F.col("c._p.end") + F.length("c._w") + F.length(raw) - F.length(F.regexp_replace(raw, _LEADING, ""))
    left = F.regexp_replace(F.lower("c._l"), r"\s+", " ")
    both = F.when((F.col("c._r") != "") & ~left.contains(" "), F.concat_ws(" _ ", left, F.lower("c._r")))
    return rows.select(*df.columns, left.alias("left"), both.alias("both"), _trimmed(raw).alias("token"), start.alias("start")).where(F.length("token") > 0)


def _patterns_of(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each pattern next to a candidate."""
    return rows.select(*columns, F.explode(F.array("left", "both")).alias("pattern")).where("pattern is not null")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _spots(words: Column, last: int) -> Column:
    """The places 0, 1, ... of an array of which ``last`` more follow."""
    return F.when(F.size(words) > last, F.sequence(F.lit(0), F.size(words) - 1 - last)).otherwise(F.array().cast("array<int>"))


def graph_of(marked: DataFrame) -> DataFrame:
    """``pattern, token, seed, n`` of marked texts."""

    def instance(words: Column, i: Column) -> Column:
        left, sign = F.lower(F.get(words, i)), F.get(words, i).rlike(rf"^{_SIGN}$") & (i > 0)
        right = F.lower(F.get(words, i + 2))
        return F.struct(
            F.when(sign, F.concat_ws(" ", F.lower(F.get(words, i - 1)), left)).otherwise(left).alias("left"),
            F.when(~sign & right.isNotNull(), F.concat_ws(" _ ", left, right)).alias("both"),
            F.get(words, i + 1).alias("token"),
        )

    def instances(words: Column) -> Column:
        here = F.filter(_spots(words, 1), lambda i: F.get(words, i + 1).rlike(f"[0-9@{_ANY_MARK}]"))
        return F.transform(here, lambda i: instance(words, i))

    rows = marked.select(F.explode(_bound(_words(F.col("text")), instances)).alias("c"))
    rows = rows.select("c.left", "c.both", _trimmed(F.col("c.token")).alias("token")).where(F.length("token") > 0)
    pairs = _patterns_of(rows, "token").withColumn("seed", _seed(F.col("token")))
    token = F.when(F.col("seed").isNull(), F.col("token")).otherwise(F.regexp_extract("token", _MARKED, 0))
    seed = F.coalesce("seed", F.when(F.col("token").rlike(KEY), F.lit(SECRET)))
    return pairs.select("pattern", token.alias("token"), seed.alias("seed")).groupBy("pattern", "token", "seed").agg(F.count(F.lit(1)).alias("n"))


def _occurrences(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pattern, total``: how often each wanted pattern stands anywhere, with any word in its place."""
    rows = [r[0] for r in wanted.select("pattern").limit(MOST_PATTERNS + 1).collect()]
    few = len(rows) <= MOST_PATTERNS
    pairs = [p.split(" _ ") for p in rows if " _ " in p]
    # Only spares rows that the join below would drop; with many patterns it drops them all.
    among = lambda word, some: word.isin(sorted(set(some))) if few else F.lit(True)

    def found(words: Column) -> Column:
        left = F.filter(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: among(w, [p for p in rows if " " not in p]))
        here = F.filter(_spots(words, 2), lambda i: among(F.get(words, i), [p[0] for p in pairs]) & among(F.get(words, i + 2), [p[1] for p in pairs]))
        both = F.transform(here, lambda i: F.concat_ws(" _ ", F.get(words, i), F.get(words, i + 2)))
        signs = F.filter(_spots(words, 2), lambda i: F.get(words, i + 1).rlike(rf"^{_SIGN}$"))
        return F.concat(left, both, F.transform(signs, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))

    every = marked.select(F.explode(_bound(_words(F.lower("text")), found)).alias("pattern"))
    return every.join(small(wanted), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def bootstrapped(edges: DataFrame, work: shared.Work) -> DataFrame:
    """``pattern, kind, score`` of accepted patterns; ``edges(pattern, token, seed, n, total)``."""
    accepted, before = work.written(edges.select("token", F.col("seed").alias("kind")).limit(0), "accepted"), -1
    while True:
        state = edges.join(accepted, "token", "left").withColumn("kind", F.coalesce("seed", "kind")).drop("seed")
        state = work.written(state, "state")
        kinds = state.where("kind is not null")
        share = kinds.groupBy("pattern", "kind").agg((F.sum("n") / F.first("total")).alias("share"), F.count_distinct("token").alias("known"))
        share = work.written(share, "share")
        # An open instance has the mean of its patterns' scores.
        open_ = state.where("kind is null").drop("kind")
        mean = open_.join(share, "pattern").groupBy("token", "kind").agg(F.sum(F.col("n") * F.col("share")).alias("s"))
        mean = mean.join(open_.groupBy("token").agg(F.sum("n").alias("all")), "token").select("token", "kind", (F.col("s") / F.col("all")).alias("confidence"))
        more = open_.join(mean, "token").groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("confidence")) / F.first("total")).alias("more"))
        scored = share.join(more, ["pattern", "kind"], "left").withColumn("score", F.col("share") + F.coalesce("more", F.lit(0.0)))
        best = work.written(scored.where((F.col("score") >= LEAST_SCORE) & (F.col("known") >= LEAST_SEEDS)).select("pattern", "kind", "score"), "best")
        found = edges.where("seed is null").join(best, "pattern").groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        accepted = work.written(found, "accepted")
        after = accepted.count()
        if after <= before or not after:
            return best
        before = after


def patterns(docs: DataFrame, work: shared.Work, text_col: str = "text") -> DataFrame:
    """``pattern, kind, score``: what stands next to identifiers of a kind, from all documents."""
    slim = docs.select(F.col(text_col).alias("text"))
    # Filters stand before the marking: one after it would make Spark mark twice.
    graph = work.written(graph_of(_marked(slim.where(F.col("text").rlike("[0-9@]")))), "graph")
    plausible = graph.groupBy("pattern").agg(F.count_distinct("token").alias("tokens"), F.sum("n").alias("instances")).where(F.col("tokens") >= LEAST_SEEDS)
    plausible = work.written(plausible.select("pattern", "instances"), "plausible")
    # What cannot reach the score even with all of its instances at confidence 1 is left out of the graph. What a part of
    # the texts shows already to be too frequent need not be counted in the others.
    can = F.col("instances") >= LEAST_SCORE * F.coalesce("total", F.lit(0))
    slim = slim.where("text is not null")
    part = _occurrences(_marked(slim.where(F.pmod(F.xxhash64("text"), F.lit(32)) == 0)), plausible.select("pattern"))
    plausible = work.written(plausible.join(part, "pattern", "left").where(can).select("pattern", "instances"), "plausible")
    totals = _occurrences(_marked(slim), plausible.select("pattern"))
    hopeful = work.written(plausible.join(totals, "pattern").where(can).select("pattern", "total"), "hopeful")
    edges = work.written(graph.join(small(hopeful), "pattern"), "edges")
    return bootstrapped(edges, work)


def discovered(docs: DataFrame, found: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """``key`` and ``extra``: spans (start, end, kind) of unseen identifiers next to accepted patterns."""
    best = found.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    texts = docs.select(*key, F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    firsts = [r[0] for r in best.select(F.substring_index("pattern", " ", 1)).distinct().limit(MOST_FIRSTS + 1).collect()]
    if len(firsts) <= MOST_FIRSTS:  # spares texts that hold no accepted pattern
        texts = texts.where(reduce(lambda x, y: x | y, [F.lower("text").contains(w) for w in firsts]))
    texts = texts.distinct()
    rows = candidates(_marked(texts)).drop("text")
    rows = _patterns_of(rows.where(_seed(F.col("token")).isNull()), *key, "token", "start").join(small(best), "pattern")
    rows = rows.groupBy(*key, "token", "start").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    span = F.struct("start", (F.col("start") + F.length("token")).alias("end"), "kind")
    return rows.groupBy(*key).agg(F.sort_array(F.collect_set(span)).alias("extra"))


def spans(docs: DataFrame) -> DataFrame:
    """``docs(..., text)``, without columns ``pii_*``, with ``pii_<kind>`` (seeds), ``pii_base`` and ``pii_spans``: all spans
    as (kind number, start, end, kind), sorted."""

    def named(i: int, kind: str):
        return lambda s: F.struct(F.lit(i).alias("number"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    work = shared.Work(docs.sparkSession)
    base = [F.transform(f"pii_{k}", named(i, k)) for i, k in enumerate(KINDS)]
    out = seeds(docs).withColumn("pii_base", F.concat(*base))
    best = patterns(docs, work)
    if best.isEmpty():
        work.clear()
        return out.withColumn("pii_spans", F.col("pii_base"))
    tid = F.xxhash64("text")
    extra = shared.written(discovered(docs.select("text", tid.alias("tid")), best, ["tid"]), "extra")
    work.clear()
    out = out.withColumn("tid", tid).join(extra, "tid", "left").drop("tid")
    free = F.filter(F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda x: ~F.exists("pii_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    number = lambda x: F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), x["kind"]).cast("int") - 1
    more = F.transform(free, lambda x: F.struct(number(x).alias("number"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return out.withColumn("pii_spans", F.array_sort(F.concat("pii_base", more))).drop("extra")


def _listed(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; columns as before. Null texts stay null."""
    names = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)}  # free of the working names
    found = spans(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]))
    by_place = F.sort_array(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        end = -x["back"]
        gap = F.substring("text", s["at"] + 1, x["start"] - s["at"])
        new = F.struct(end.alias("at"), F.concat(s["out"], F.array(F.concat(gap, F.lit("["), x["kind"], F.lit("]")))).alias("out"))
        return F.when(x["start"] >= s["at"], new).otherwise(F.struct(F.greatest(s["at"], end).alias("at"), s["out"].alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(by_place, first, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring("text", s["at"] + 1, F.length("text"))))
    done = found.withColumn("text", F.when(F.size("pii_spans") > 0, text).otherwise(F.col("text")))
    return done.select(*[F.col(x).alias(c) for c, x in names.items()])
