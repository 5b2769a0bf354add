"""Preference formatting in DataFrame functions only: shared prompt once, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import free_name
from gaugeworks.llm.quality import bind

#: A turn is OPEN role CLOSE text END; a marker within a text is broken up by a space.
OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"
TRAINED = "assistant"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, turns)``: each conversation's turns in order. Null roles and texts are empty; ties go by role, then text.

    Turns without an id make up one conversation, whose id is null. A null turn number comes first. A conversation is
    one row, so it has to fit into a task, as it would into any training sequence.
    """
    row = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def _said(x: Column) -> Column:
    return F.struct(x["role"].alias("role"), x["text"].alias("text"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from the start."""

    def count(x: Column) -> Column:
        most = F.least(F.size(x["a"]), F.size(x["b"]))
        differs = F.filter(F.sequence(F.lit(0), most - 1), lambda i: _said(x["a"][i]) != _said(x["b"][i]))
        return F.when(most == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)), most))

    return bind(F.struct(a.alias("a"), b.alias("b")), count)


def _turn(x: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(x["role"]), F.lit(CLOSE), safe(x["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column) -> Column:
    """Where in the rendered turns the loss counts: ``start:end`` of each trained turn's text and end mark, in code points."""

    def spans(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, t: Column) -> Column:
            stop = acc["at"] + F.length(_turn(t))
            start = acc["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
            return F.struct(stop.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(F.concat_ws(":", start.cast("string"), stop.cast("string"))))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(x, zero, step, lambda acc: F.array_join(acc["out"], ","))

    return bind(turns, spans)


def _upto_reply(turns: Column) -> Column:
    """A conversation up to its last reply; without one, empty."""
    last = F.aggregate(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return bind(F.struct(turns.alias("t"), last.alias("n")), lambda x: F.slice(x["t"], 1, x["n"]))


def _off_topic(turns: Column) -> Column:
    """The same conversation with its last reply replaced by the reply before it, or by an empty one."""

    def swap(t: Column) -> Column:
        before = F.filter(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: x["role"] == TRAINED)
        text = F.coalesce(F.get(before, F.size(before) - 1)["text"], F.lit(""))
        last = F.get(t, F.size(t) - 1)
        new = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), text.alias("text"))
        return F.when(F.size(t) == 0, t).otherwise(F.concat(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.array(new)).cast(_TURNS))

    return bind(turns, swap)


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with its two arrays of turns replaced by the shared prompt, rendered once, and two completions with masks.

    The prompt is the longest common prefix of turns. Equal conversations share all: both completions are
    empty. Empty ones share nothing.
    """
    n = common_turns(F.col(chosen), F.col(rejected))

    def parts(x: Column) -> Column:
        rest = lambda c: F.slice(x[c], x["n"] + 1, F.size(x[c]))
        return F.struct(
            x["n"].cast("long").alias("n_prompt_turns"), rendered(F.slice(x["a"], 1, x["n"])).alias("prompt"),
            rendered(rest("a")).alias("chosen_text"), mask(rest("a")).alias("chosen_mask"), rendered(rest("b")).alias("rejected_text"), mask(rest("b")).alias("rejected_mask"),
        )

    whole = bind(F.struct(F.col(chosen).alias("a"), F.col(rejected).alias("b"), n.alias("n")), parts)
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    name = free_name(pairs, "parts")
    return pairs.select(*others, whole.alias(name)).select(*others, f"{name}.*")


def preference_pairs(turns: DataFrame, **columns) -> DataFrame:
    """Preference pairs from plain conversations: ``id, other_id, chosen, rejected``, a row for each conversation with a reply.

    Chosen is the conversation up to its last reply. Rejected is the first conversation (by id) that opens with the
    same turn, so a group of n conversations gives n - 1 such pairs and a popular opening costs no pairing within
    its group; for the first one, and where no other opens so, it is the conversation with its last reply
    replaced by the reply before (or none): an answer to another question.
    """
    whole = conversations(turns, **columns).select("id", _upto_reply(F.col("turns")).alias("chosen")).where("size(chosen) > 0")
    whole = whole.withColumn("opening", F.sha2(_turn(F.get(F.col("chosen"), F.lit(0))), 256))
    first = whole.groupBy("opening").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    heads = first.join(whole.select(F.col("id").alias("first"), F.col("chosen").alias("other")), "first").select("opening", "first", "other")
    joined = whole.join(heads, "opening", "left")
    use = F.col("first").isNotNull() & (F.col("first") != F.col("id"))
    return joined.select("id", F.when(use, F.col("first")).alias("other_id"), "chosen", F.when(use, F.col("other")).otherwise(_off_topic(F.col("chosen"))).alias("rejected"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return formatted(pairs).withColumnRenamed("id", "conv_id")


SQL = """
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM s GROUP BY conv_id),
u AS (SELECT conv_id, t[:coalesce(list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i ELSE 0 END)), 0)] AS t FROM c),
w AS MATERIALIZED (SELECT conv_id, t, t[1].role AS fr, t[1].text AS ft FROM u WHERE len(t) > 0),
g AS (SELECT fr, ft, min(conv_id) AS first FROM w GROUP BY ALL HAVING count(*) > 1),
p AS MATERIALIZED (SELECT w.conv_id, CASE WHEN g.first <> w.conv_id THEN g.first END AS other_id, w.t AS a,
  CASE WHEN g.first <> w.conv_id THEN o.t ELSE list_concat(w.t[:len(w.t) - 1], [{'turn': w.t[len(w.t)].turn, 'role': w.t[len(w.t)].role, 'text': coalesce(list_filter(w.t[:len(w.t) - 1], lambda x: x.role = 'assistant')[-1].text, '')}]) END AS b
  FROM w LEFT JOIN g USING (fr, ft) LEFT JOIN w o ON o.conv_id = g.first),
n AS MATERIALIZED (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, least(len(a), len(b))) AS n FROM p),
r AS (SELECT conv_id, other_id, n, a[:n] AS pr, a[n + 1:] AS a, b[n + 1:] AS b FROM n),
e AS (SELECT conv_id, side, i, role, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS x, 4 + length(role) + 1 AS head
  FROM (SELECT conv_id, side, i, t[i].role AS role, t[i].text AS text FROM (SELECT conv_id, side, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, 'p' AS side, pr AS t FROM r UNION ALL SELECT conv_id, 'a', a FROM r UNION ALL SELECT conv_id, 'b', b FROM r)))),
m AS (SELECT *, (sum(length(x)) OVER (PARTITION BY conv_id, side ORDER BY i))::BIGINT AS stop FROM e),
k AS (SELECT conv_id, side, string_agg(x, '' ORDER BY i) AS x, string_agg((stop - length(x) + head) || ':' || stop, ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM m GROUP BY ALL)
SELECT r.conv_id, other_id, n::BIGINT AS n_prompt_turns, coalesce(kp.x, '') AS prompt, coalesce(ka.x, '') AS chosen_text, coalesce(ka.mask, '') AS chosen_mask, coalesce(kb.x, '') AS rejected_text, coalesce(kb.mask, '') AS rejected_mask
FROM r LEFT JOIN k kp ON kp.conv_id = r.conv_id AND kp.side = 'p' LEFT JOIN k ka ON ka.conv_id = r.conv_id AND ka.side = 'a' LEFT JOIN k kb ON kb.conv_id = r.conv_id AND kb.side = 'b'
"""
