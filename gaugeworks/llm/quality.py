"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain on a document; expectation-maximisation over the counts of vote patterns
estimates how often each rule is right on good and on bad documents. Only the first guess is set by hand. A
document is kept by its posterior probability of "good", so a bad vote of a rule that is often wrong doesn't
reject it, and abstentions that good documents seldom cause may.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import WORD_GAP, free_name, stored

SYMBOLS = "[^#*$%&|<>]+"
LETTER = r"\p{L}"
ROUNDS = 30
#: A rule's accuracies, estimated from the votes alone: how often it votes good on good documents, bad on good ones
#: (a false alarm), bad on bad ones (caught) and good on bad ones (missed).
ACCURACIES = ("yes", "alarm", "caught", "missed")
OTHER = {"yes": "missed", "missed": "yes", "alarm": "caught", "caught": "alarm"}
#: First guesses, the same for each rule, and the share of good documents; that whose fit is likeliest is taken. "Bad" is
#: the class in which rules vote "bad" more often, all in all.
STARTS = (
    {"yes": 0.8, "alarm": 0.05, "caught": 0.4, "missed": 0.5, "prior": 0.8}, {"yes": 0.8, "alarm": 0.1, "caught": 0.4, "missed": 0.5, "prior": 0.6},
    {"yes": 0.6, "alarm": 0.05, "caught": 0.2, "missed": 0.5, "prior": 0.8}, {"yes": 0.7, "alarm": 0.2, "caught": 0.3, "missed": 0.5, "prior": 0.6},
)
#: Added to the count of each of a rule's three votes in either class, so that no rate is exactly 0.
SMOOTH = 1.0
#: (name, condition for good, condition for bad), as SQL over the measures; else the rule abstains. Each looks at another
#: side of a text. Limits for bad are those in use for web text (a symbol for ten words, letters in four words of five, words of 3 to 10
#: characters, three lines of ten repeated); no label was used to set one.
RULES = (
    ("length", "n_words >= 200", "n_words < 100"),
    ("symbols", "10 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("letters", "10 * n_letter_words >= 9 * n_words", "10 * n_letter_words < 8 * n_words"),
    ("word_size", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars > 10 * n_words OR word_chars < 3 * n_words"),
    ("repeats", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 20 * n_words"),
    ("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("sentences", "100 * n_ends BETWEEN 2 * n_words AND 20 * n_words", "100 * n_ends < n_words OR 100 * n_ends > 33 * n_words"),
    ("capitals", "100 * n_upper <= 10 * word_chars", "100 * n_upper > 30 * word_chars"),
    ("variety", "100 * n_distinct >= 40 * n_words", "100 * n_distinct < 25 * n_words"),
)


def bind(value: Column, use) -> Column:
    """``use`` over ``value`` evaluated once: a lambda's variable isn't substituted by the optimiser."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct((x + 3).alias("end"), (acc["n"] + x + 3 - F.greatest(x, acc["end"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def repeated(order: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return ((k > 0) & (order[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(order) - 1) & (order[F.least(k + 1, F.size(order) - 1)]["h"] == x["h"]))

        return covered(F.sort_array(F.transform(F.filter(order, twin), lambda x: x["i"])))

    def search(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(F.sort_array(keyed), repeated))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(hashes, search))


def measures(docs: DataFrame, text_col: str = "text", as_col: str = "m") -> DataFrame:
    """``docs`` with one struct column of long counts. Null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.rlike(LETTER))).cast("long").alias("n_letter_words"),
            F.size(F.filter(words, lambda w: F.substring(w, -1, 1).isin(".", "!", "?"))).cast("long").alias("n_ends"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = bind(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), of_words)
    lines = bind(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    symbols = F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    whole = bind(F.struct(words.alias("w"), lines.alias("l"), symbols.alias("s"), upper.alias("u")), lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["s"].alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"),
        x["l"]["n_lines"].alias("n_lines"), x["u"].alias("n_upper"), *[x["w"][c].alias(c) for c in ("n_repeat_words", "n_letter_words", "n_ends", "n_distinct")]))
    return docs.withColumn(as_col, whole)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letter_words", "n_ends", "n_distinct")


#: The base rule.
FAILED = "(m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words)"


def _of(text: str, struct: str) -> str:
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{struct}.\1", text)


def _votes_sql(rules, struct: str) -> list[str]:
    """1 good, -1 bad, 0 abstain, for each rule."""
    return [f"CASE WHEN {_of(bad, struct)} THEN -1 WHEN {_of(good, struct)} THEN 1 ELSE 0 END" for _, good, bad in rules]


def votes(struct: str, rules=RULES) -> Column:
    """A struct ``v0..`` of all votes. The measures are named once, so that they are worked out once wherever this moves to."""
    fields = ", ".join(f"'v{j}', {v}" for j, v in enumerate(_votes_sql(rules, "m")))
    return F.expr(f"transform(array({struct}), m -> named_struct({fields}))[0]")


def _odds_sql(model: list[dict[str, float]], struct: str) -> tuple[str, str]:
    """Chances of a pattern of votes for good and for bad documents."""

    def side(up: str, down: str) -> str:
        return " * ".join(f"CASE {struct}.v{j} WHEN 1 THEN {r[up]!r}D WHEN -1 THEN {r[down]!r}D ELSE {1 - r[up] - r[down]!r}D END" for j, r in enumerate(model))

    return side("yes", "alarm"), side("missed", "caught")


def verdict(struct: str, model: list[dict[str, float]], prior: float, rules=RULES) -> Column:
    """The measures with ``base_failed``, posterior ``p_good``, the votes and ``kept``; the measures are named once."""
    fields = ", ".join(f"'v{j}', {v}" for j, v in enumerate(_votes_sql(rules, "m")))
    good, bad = (f"{p!r}D * {x}" for p, x in zip((prior, 1 - prior), _odds_sql(model, "v"), strict=True))
    known = ", ".join(f"'{c}', m.{c}" for c in MEASURES)
    named = ", ".join(f"'vote_{r[0]}', v.v{j}" for j, r in enumerate(rules))
    odds = f"transform(array(named_struct('g', {good}, 'b', {bad})), o -> o.g / (o.g + o.b))[0]"
    scored = f"transform(array(named_struct({fields})), v -> named_struct({known}, 'base_failed', {FAILED}, 'p_good', {odds}, {named}))[0]"
    every = ", ".join(f"'{c}', r.{c}" for c in (*MEASURES, "base_failed", "p_good", *(f"vote_{r[0]}" for r in rules)))
    return F.expr(f"transform(array({struct}), m -> transform(array({scored}), r -> named_struct({every}, 'kept', NOT r.base_failed AND r.p_good >= 0.5D))[0])[0]")


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS, starts=STARTS) -> tuple[list[dict[str, float]], float]:
    """Each rule's accuracies and the share of good documents, by expectation-maximisation from several first guesses; the likeliest fit is returned.

    ``patterns(v0.., n)`` counts each vote pattern, at most 3 to the power of the number of rules (19683), whatever the input's
    size. All rounds are one expression over that bounded list; one row with the estimates goes to the driver.
    """
    row = F.struct(F.array(*[F.col(f"v{j}") for j in range(n_rules)]).alias("v"), F.col("n").cast("double").alias("n"))
    listed = patterns.agg(F.sort_array(F.collect_list(row)).alias("ps"))
    rule = lambda of: F.struct(*[of(k).alias(k) for k in ACCURACIES])
    state = lambda rs, prior: F.struct(rs.alias("rs"), prior.alias("prior"))
    total = lambda qs, of: F.aggregate(qs, F.lit(0.0), lambda x, q: x + of(q))

    def chance(p: Column, rs: Column, up: str, down: str) -> Column:
        part = lambda v, r: F.when(v == 1, r[up]).when(v == -1, r[down]).otherwise(1.0 - r[up] - r[down])
        return F.aggregate(F.zip_with(p["v"], rs, part), F.lit(1.0), lambda x, y: x * y)

    def chances(now: Column, p: Column) -> tuple[Column, Column]:
        return now["prior"] * chance(p, now["rs"], "yes", "alarm"), (1.0 - now["prior"]) * chance(p, now["rs"], "missed", "caught")

    def round_(now: Column, ps: Column) -> Column:
        def share(p: Column) -> Column:
            good, bad = chances(now, p)
            return F.struct(p["v"].alias("v"), (p["n"] * good / (good + bad)).alias("g"), (p["n"] * bad / (good + bad)).alias("b"))

        def improve(qs: Column) -> Column:
            def better(whole: Column) -> Column:
                def of_rule(_: Column, j: Column) -> Column:
                    def rate(k: str) -> Column:
                        vote, side = (1 if k in ("yes", "missed") else -1), ("g" if k in ("yes", "alarm") else "b")
                        seen = total(qs, lambda q: F.when(q["v"][j] == vote, q[side]).otherwise(F.lit(0.0)))
                        return (seen + SMOOTH) / (whole[side] + 3 * SMOOTH)

                    return rule(rate)

                prior = (whole["g"] + SMOOTH) / (whole["g"] + whole["b"] + 2 * SMOOTH)
                return state(F.transform(now["rs"], of_rule), prior)

            return bind(F.struct(total(qs, lambda q: q["g"]).alias("g"), total(qs, lambda q: q["b"]).alias("b")), better)

        return bind(F.transform(ps, share), improve)

    def fitted(start: dict[str, float]) -> Column:
        first = state(F.array(*[rule(lambda k: F.lit(start[k]))] * n_rules), F.lit(start["prior"]))
        steps = F.when(F.size("ps") > 0, F.sequence(F.lit(1), F.lit(rounds))).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(steps, first, lambda now, _: round_(now, F.col("ps")))
        likely = lambda s: total(F.col("ps"), lambda p: p["n"] * F.log(sum(chances(s, p))))
        return bind(last, lambda s: F.struct(s.alias("s"), likely(s).alias("l")))

    found = listed.select(*[fitted(x).alias(f"f{i}") for i, x in enumerate(starts)]).first()
    best = max(found, key=lambda f: round(f["l"] or 0.0, 6))["s"]  # the first of equals
    rates, prior = [r.asDict() for r in best["rs"]], best["prior"]
    if sum(r["alarm"] for r in rates) > sum(r["caught"] for r in rates):  # the classes stand the other way round
        return [{k: r[OTHER[k]] for k in ACCURACIES} for r in rates], 1 - prior
    return rates, prior


def patterns(measured: DataFrame, name: str, rules=RULES) -> DataFrame:
    """``v0.., n``: how many documents have each pattern of votes. Those that fail the base rule are decided already and not counted."""
    failed = F.expr(f"transform(array({name}), m -> {FAILED})[0]")
    return measured.where(~failed).select(votes(name, rules).alias("v")).groupBy(*[f"v.v{j}" for j in range(len(rules))]).agg(F.count("*").alias("n"))


def _judge(measured: DataFrame, name: str, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    model, prior = fit(stored(patterns(measured, name, rules), "votes"), len(rules), rounds)
    return measured.withColumn(name, verdict(name, model, prior, rules))


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of measures, ``base_failed``, ``p_good`` and ``kept``; and that column's name.

    Two passes over the texts: one counts vote patterns, one scores. No row leaves its partition but as a count.
    Null or empty text fails the base rule. An empty table gives no rows. Equal texts get equal verdicts.
    """
    name = free_name(docs, "quality")
    return _judge(measures(docs, text_col, name), name, rules, rounds), name


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: measures, base rule, posterior and verdict. Texts are read once: only their measures are stored, and judged from there."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    full = _judge(stored(measures(narrow, "t", "quality").select("id", "quality"), "measures"), "quality")
    return full.select(F.col("id").alias(id_col), *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are rejected; columns unchanged."""
    full, name = judged(docs, text_col)
    return full.where(f"{name}.kept").drop(name)


def _sql() -> str:
    gap = r"[\x20\x09-\x0D]+"
    v = [f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, good, bad) in enumerate(RULES)]
    n = len(RULES)
    side = lambda up, down: " * ".join(f"CASE v{j} WHEN 1 THEN e.{up}{j} WHEN -1 THEN e.{down}{j} ELSE 1 - e.{up}{j} - e.{down}{j} END" for j in range(n))
    good, bad = f"e.prior * {side('yes', 'alarm')}", f"(1 - e.prior) * {side('missed', 'caught')}"
    first = " UNION ALL ".join(f"SELECT {i} AS start, {', '.join(f'{x[k]}::DOUBLE AS {k}{j}' for j in range(n) for k in ACCURACIES)}, {x['prior']}::DOUBLE AS prior" for i, x in enumerate(STARTS))
    parts = [f"e0 AS ({first})"]
    for r in range(ROUNDS):
        parts.append(f"o{r} AS (SELECT pt.*, e.start, {good} AS og, {bad} AS ob FROM pt, e{r} e)")
        parts.append(f"q{r} AS MATERIALIZED (SELECT *, n * og / (og + ob) AS g, n * ob / (og + ob) AS b FROM o{r})")
        side_of = lambda k: "g" if k in ("yes", "alarm") else "b"
        rate = lambda k, j: f"(coalesce(sum({side_of(k)}) FILTER (v{j} = {1 if k in ('yes', 'missed') else -1}), 0) + {SMOOTH}) / (sum({side_of(k)}) + {3 * SMOOTH}) AS {k}{j}"
        parts.append(f"e{r + 1} AS MATERIALIZED (SELECT start, {', '.join(rate(k, j) for j in range(n) for k in ACCURACIES)}, (sum(g) + {SMOOTH}) / (sum(g) + sum(b) + {2 * SMOOTH}) AS prior FROM q{r} GROUP BY start)")
    parts.append(f"likely AS (SELECT start FROM (SELECT e.start, pt.n * ln({good} + {bad}) AS l FROM pt, e{ROUNDS} e) GROUP BY start ORDER BY round(sum(l), 6) DESC, start LIMIT 1)")
    turned = f"{' + '.join(f'alarm{j}' for j in range(n))} > {' + '.join(f'caught{j}' for j in range(n))}"
    sides = ", ".join(f"CASE WHEN {turned} THEN {OTHER[k]}{j} ELSE {k}{j} END AS {k}{j}" for j in range(n) for k in ACCURACIES)
    parts.append(f"best AS MATERIALIZED (SELECT {sides}, CASE WHEN {turned} THEN 1 - prior ELSE prior END AS prior FROM e{ROUNDS} e JOIN likely USING (start))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, list_filter(string_split_regex(t, '{gap}'), lambda x: x <> '') AS w FROM d),
x AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM x),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM y, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
f AS MATERIALIZED (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
  len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}')))::BIGINT AS n_letter_words, len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?')))::BIGINT AS n_ends, len(list_distinct(w))::BIGINT AS n_distinct
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
g AS MATERIALIZED (SELECT *, {', '.join(v)} FROM f),
pt AS MATERIALIZED (SELECT {', '.join(f'v{j}' for j in range(n))}, count(*) AS n FROM g WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY ALL),
{', '.join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND og / (og + ob) >= 0.5 AS kept, round(og / (og + ob), 6) AS p_good
FROM (SELECT g.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, {good} AS og, {bad} AS ob FROM g, best e)
"""


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("p_good", F.round("p_good", 6))


SQL = _sql()
