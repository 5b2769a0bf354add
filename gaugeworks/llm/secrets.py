"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import free_name
from gaugeworks.llm.quality import bind


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Group 2 is the value.
ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: Window of the entropy scan, in characters.
WINDOW = 20
#: (kind, pattern of its candidate strings, least entropy in bits a character) by character class.
CLASSES = (("entropy_text", "[A-Za-z0-9+/_=-]{20,}", 3.9), ("entropy_hex", "[0-9a-fA-F]{20,}", 3.0))
#: A candidate that one of these finds is let pass; so is one without both letters and digits.
ALLOWED = ("[eE][xX][aA][mM][pP][lL][eE]", "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "(0123456789|abcdefghij|ABCDEFGHIJ|1234567890)")
#: Every character that a candidate may have; a window's counts are kept by place in it.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Long strings and lists are worked on in blocks of so many, as growing one long result copies it at each step.
BLOCK = 64
#: Code points of text in a piece from which masked text is cut out.
PIECE = 4096
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
_SCALE = 1_000_000
#: c * log2(c) in whole millionths, so that sums are exact in any order.
_TERMS = [0, *(round(c * log2(c) * _SCALE) for c in range(1, WINDOW + 1))]
_SPAN = "struct<start:int,kind:int,stop:int>"


def most(bits: float) -> int:
    """The largest sum of c * log2(c) over a window whose entropy is at least ``bits``."""
    return int((log2(WINDOW) - bits) * WINDOW * _SCALE)


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _scan(values: Column, zero, step) -> Column:
    """Running results of ``step`` over an array of ints, each with its own value included, in work linear in the array.

    An array can only grow by a copy, so the running results are made block by block, and the blocks' totals are
    carried into them afterwards.
    """
    grown = lambda out, x: F.concat(out, F.array(x))
    state = lambda last, out: F.struct(last.cast("int").alias("last"), out.alias("out"))
    none = state(F.lit(zero), F.array().cast("array<int>"))

    def run(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, x: bind(step(acc["last"], x), lambda y: state(y, grown(acc["out"], y))), lambda acc: acc["out"])

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda b: run(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))

        def carried(bs: Column) -> Column:
            before = F.aggregate(bs, none, lambda acc, x: state(step(acc["last"], F.element_at(x, -1)), grown(acc["out"], acc["last"])), lambda acc: acc["out"])
            return F.flatten(F.zip_with(bs, before, lambda x, o: F.transform(x, lambda y: step(o, y).cast("int"))))

        return F.when(F.size(xs) == 0, F.array().cast("array<int>")).when(F.size(xs) <= BLOCK, run(xs)).otherwise(bind(blocks, carried))

    return bind(values, whole)


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """For each match its start, stop and index, from the lengths of matches and of the gaps between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)

    def place(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: x["g"][i] + F.when(i > 0, F.get(x["m"], i - 1)).otherwise(0))
        starts = _scan(steps, 0, lambda total, n: total + n)
        return F.zip_with(F.transform(starts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), x["m"], lambda s, m: F.struct(s["s"].alias("start"), (s["s"] + m).alias("stop"), s["i"].alias("i")))

    return bind(F.struct(gaps.alias("g"), sizes.alias("m")), place)


def _base(text: Column, kind: str, pattern: str, group: int | None = None) -> Column:
    """Spans of a fixed pattern; with ``group``, only those whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = KINDS.index(kind)
    as_span = lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("kind"), p["stop"].alias("stop"))
    if group is None:
        spans = F.transform(_placed(text, pattern, whole), as_span)
    else:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        spans = bind(values, lambda v: F.transform(F.filter(_placed(text, pattern, whole), lambda p: F.length(v[p["i"]]) >= ASSIGN_VALUE), as_span))
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def _block(text: Column, limit: int) -> Column:
    """Where in a short string windows with high entropy start.

    A fold over the characters carries how often each is in the window, five bits a character, twelve to a long: one
    comes in, one goes out, and the sum of n * log2(n) moves on by what these two counts change.
    """
    term = lambda n: F.element_at(F.array(*map(F.lit, _TERMS)), n + 1)
    slot = lambda c: F.floor(c / 12).cast("int")
    held = lambda counts, c: F.call_function("shiftright", F.get(counts, slot(c)), c % 12 * 5).bitwiseAND(F.lit(31)).cast("int")
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c % 12 * 5)
    changed = lambda counts, c, by: F.transform(counts, lambda x, k: F.when(k == slot(c), x + by * unit(c)).otherwise(x))
    state = lambda counts, total, out: F.struct(counts.alias("n"), total.alias("sum"), out.alias("out"))

    def scan(codes: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            def leave(c: Column) -> Column:
                return bind(held(acc["n"], c), lambda n: state(changed(acc["n"], c, -1), acc["sum"] + term(n - 1) - term(n), acc["out"]))

            def enter(now: Column) -> Column:
                c = codes[j]
                return bind(held(now["n"], c), lambda n: state(changed(now["n"], c, 1), now["sum"] + term(n + 1) - term(n), now["out"]))

            def note(now: Column) -> Column:
                hot = (j >= WINDOW - 1) & (now["sum"] <= limit)
                return state(now["n"], now["sum"], F.when(hot, F.concat(now["out"], F.array(j - (WINDOW - 1)))).otherwise(now["out"]))

            return bind(bind(F.when(j >= WINDOW, bind(F.get(codes, j - WINDOW), leave)).otherwise(acc), enter), note)

        zero = state(F.array_repeat(F.lit(0).cast("long"), -(-len(_ALPHABET) // 12)), F.lit(0), F.array().cast("array<int>"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["out"])

    return bind(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1), scan)


def _hot(word: Column, limit: int) -> Column:
    """Runs [from, to) of a string's windows with high entropy; windows that overlap or touch are one run."""

    def blocks(pieces: Column) -> Column:
        ahead = lambda b: F.substring(F.coalesce(F.get(pieces, b + 1), F.lit("")), 1, WINDOW - 1)
        one = lambda x, b: F.transform(_block(F.concat(x, ahead(b)), limit), lambda i: i + b * BLOCK)
        return F.flatten(F.transform(pieces, one))

    def runs(hot: Column) -> Column:
        first = F.filter(hot, lambda x, k: (k == 0) | (x - F.get(hot, k - 1) > WINDOW))
        last = F.filter(hot, lambda x, k: (k == F.size(hot) - 1) | (F.get(hot, k + 1) - x > WINDOW))
        return F.zip_with(first, last, lambda x, y: F.struct(x.alias("a"), (y + WINDOW).alias("b")))

    return bind(bind(F.regexp_extract_all(word, F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), blocks), runs)


def _suspect(word: Column) -> Column:
    out = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        out = out & ~word.rlike(pattern)
    return out


def _entropy(text: Column, kind: str, pattern: str, bits: float) -> Column:
    number = KINDS.index(kind)

    def scan(words: Column) -> Column:
        kept = F.filter(_placed(text, pattern, words), lambda p: _suspect(words[p["i"]]))
        runs = F.transform(kept, lambda p: F.transform(_hot(words[p["i"]], most(bits)), lambda r: F.struct((p["start"] + r["a"]).alias("start"), F.lit(number).alias("kind"), (p["start"] + r["b"]).alias("stop"))))
        return F.when(F.exists(words, _suspect), F.flatten(runs)).otherwise(_none())

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), scan)


def secret_spans(docs: DataFrame, text_col: str = "text", as_col: str = "secrets") -> DataFrame:
    """``docs`` with an array of spans (start, kind, stop) in code points, by start, then kind as in ``KINDS``.

    Null or empty text: no spans. A span is a fact about its own row, so repeated rows and any keys do as well.
    No shuffle; the work is linear in the length of the text, also where one candidate is all of it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_base(text, "assign", ASSIGN, 2), _base(text, "access", ACCESS), _base(text, "hex", HEX)]
    parts += [_entropy(text, *c) for c in CLASSES]
    return docs.withColumn(as_col, F.sort_array(F.concat(*[p.cast(f"array<{_SPAN}>") for p in parts])))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "s")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.sha2(_joined(F.filter("s", lambda x: x["kind"] < 3)), 256)
    return found.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), base.alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the union of each text's spans replaced by ``mask``; ``length_col`` is brought up to date. Rows all stay."""
    name = free_name(docs, "secrets")
    full = secret_spans(docs, text_col, name)
    text = F.col(text_col)

    def cut(pieces: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(stop / PIECE).cast("int") - first + 1), "")
        return F.when(stop > start, F.substring(near, start - first * PIECE + 1, stop - start)).otherwise(F.lit(""))

    def replaced(x: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(x["reach"], k - 1)).otherwise(F.lit(0))
        part = lambda s, k: bind(before(k), lambda at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(cut(x["pieces"], at, s["start"]), F.lit(mask))))
        return F.concat(F.array_join(F.transform(x["spans"], part), ""), cut(x["pieces"], F.element_at(x["reach"], -1), F.length(text)))

    reach = _scan(F.transform(name, lambda s: s["stop"]), 0, F.greatest)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    new = bind(F.struct(F.col(name).alias("spans"), reach.alias("reach"), pieces.alias("pieces")), replaced)
    full = full.withColumn(text_col, F.when(F.size(name) > 0, new).otherwise(text))
    if length_col and length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        full = full.withColumn(length_col, F.when(F.size(name) > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return full.select(*docs.columns)


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quote = lambda p: p.replace("'", "''")
    parts = []
    for number, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *((c[0], c[1]) for c in CLASSES))):
        p = quote(pattern)
        value = f"regexp_extract_all(t, '{p}', 2)" if number == 0 else "NULL::VARCHAR[]"
        parts.append(f"m{number} AS MATERIALIZED (SELECT rid, m[i] AS m, v[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::INT AS s FROM (SELECT rid, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g, {value} AS v FROM d WHERE regexp_matches(t, '{p}'))))")
        if number < 3:
            parts.append(f"k{number} AS (SELECT rid, {number} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM m{number}{' WHERE length(v) >= %d' % ASSIGN_VALUE if number == 0 else ''})")
        else:
            allowed = " AND ".join(f"NOT regexp_matches(m, '{quote(a)}')" for a in ALLOWED)
            limit = most(CLASSES[number - 3][2])
            parts.append(f"""w{number} AS (SELECT rid, s, i, substr(m, i + 1, {WINDOW}) AS w FROM (SELECT rid, s, m, unnest(range(0, length(m) - {WINDOW - 1})) AS i FROM m{number} WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {allowed})),
c{number} AS (SELECT rid, s, i, c, count(*) AS n FROM (SELECT rid, s, i, unnest(string_split(w, '')) AS c FROM w{number}) GROUP BY ALL),
h{number} AS (SELECT rid, s, i FROM c{number} GROUP BY ALL HAVING sum(({_TERMS})[n + 1]) <= {limit}),
b{number} AS (SELECT *, sum(CASE WHEN i - p <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, s ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY rid, s ORDER BY i) AS p FROM h{number})),
k{number} AS (SELECT rid, {number} AS k, '{kind}' AS kind, (s + min(i))::INT AS s, (s + max(i) + {WINDOW})::INT AS e FROM b{number} GROUP BY rid, s, run)""")
    every = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(KINDS)))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(parts)},
a AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM ({every}) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
