"""URL filters: explicit rules by host and path, and a weighted vocabulary of terms for what no rule names.

One Aho-Corasick automaton finds all terms of a URL in one pass over it. A term counts where no letter or digit stands
beside it. One strict term, or several distinct soft ones, reject.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each of these rejects alone.
STRICT = ("casino", "casinos", "gambling", "jackpot", "sportsbook", "porn", "porno", "xxx", "hentai", "camgirls", "escorts", "viagra", "cialis", "warez", "keygen", "torrents")
#: SOFT_LIMIT distinct ones of these reject; each of them also stands in harmless addresses.
SOFT = ("free", "cheap", "win", "winner", "bet", "bets", "bonus", "pills", "pharmacy", "poker", "slots", "loan", "loans", "ads", "adserver", "track", "tracker", "popup", "clicks", "affiliate", "dating", "nude", "crack", "promo", "discount", "replica")
SOFT_LIMIT = 2
#: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_LOWER = {a: a + 32 for a in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without a ``://``."""
    start = (url or "").find("://")
    if start < 0:
        return "", ""
    start += 3
    ends = [len(url), *(x for x in (url.find("?", start), url.find("#", start)) if x >= 0)]
    whole = url[start : min(ends)]
    host, slash, path = whole.partition("/")
    return host.translate(_LOWER), slash + path


def automaton(strict, soft) -> ahocorasick.Automaton:
    """All terms in lower case; a term that is both counts as strict."""
    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (2, strict)):
        for term in terms:
            if term:
                found.add_word(term.translate(_LOWER), (kind, term.translate(_LOWER)))
    if len(found):
        found.make_automaton()
    return found


def _wordy(c: str) -> bool:
    return c.isascii() and c.isalnum()


def terms(url: str | None, vocabulary: ahocorasick.Automaton) -> tuple[int, set[str]]:
    """How often strict terms stand in ``url``, and which soft ones do. Overlapping terms all count."""
    n, soft = 0, set()
    if not url or not len(vocabulary):
        return n, soft
    text = url.translate(_LOWER)
    for end, (kind, term) in vocabulary.iter(text):
        start = end - len(term)
        if (start >= 0 and _wordy(text[start])) or (end + 1 < len(text) and _wordy(text[end + 1])):
            continue
        if kind == 2:
            n += 1
        else:
            soft.add(term)
    return n, soft


class Rules:
    """Rules by host; a look-up takes one step for each label of the host and each length of path that its rules have."""

    def __init__(self, rules):
        self.paths: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.paths.setdefault(host, {})[path] = (host + path, verdict)
        self.sizes = {host: sorted({len(p) for p in paths}) for host, paths in self.paths.items()}
        self.longest = max(map(len, self.paths), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule whose host is ``host`` or above it, and whose path begins ``path``."""
        best = None
        at = max(len(host) - self.longest, 0)  # hosts of rules are no longer, so what stands before can't matter
        if at and host[at - 1] != ".":
            at = host.find(".", at) + 1
            if not at:
                return None
        while True:
            above = host[at:]
            for size in self.sizes.get(above, ()):
                hit = self.paths[above].get(path[:size]) if size <= len(path) else None
                if hit and (best is None or len(hit[0]) > len(best[0])):
                    best = hit
            at = host.find(".", at) + 1
            if not at:
                return best


def _judge(url_at: int, rules, strict, soft, soft_limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary = Rules(rules), automaton(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(url_at).to_pylist():
                host, path = parts(url)
                n, few = terms(url, vocabulary)
                name, verdict = known.find(host, path) or (None, "block" if n or len(few) >= soft_limit else "allow")
                rows.append((host, path, name, verdict, n, len(few)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return run


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``id_col, host, path, rule, verdict, n_strict, n_soft`` of every row: occurrences of strict terms, distinct soft ones.

    The longest rule (host and path together) that fits decides; without one, the vocabulary does, over the whole URL,
    also where it has no ``://``. A null URL has no host, path or terms, and is allowed. Rows that repeat and null ids are
    kept; an empty table gives no rows; other columns aren't read. Letters outside A-Z are compared as they are.

    No row leaves its partition, so a host with any share of all rows is no matter. Rules and terms are sent with the
    tasks: they are a parameter, of up to a few hundred thousand entries, and don't grow with the input.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    schema = f"id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long"
    return narrow.mapInArrow(_judge(1, tuple(rules), tuple(strict), tuple(soft), soft_limit), schema).withColumnRenamed("id", id_col)


def allowed(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` without the rows whose URL is blocked, judged as in ``judged``; columns unchanged."""
    at = pages.columns.index(url_col)
    judge = _judge(at, tuple(rules), tuple(strict), tuple(soft), soft_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for verdicts in judge(iter([batch])):
                yield batch.filter(pc.equal(verdicts.column(4), "allow"))

    return pages.mapInArrow(run, pages.schema)


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_size = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    which = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(h, p, v)}'" for h, p, v in by_size) + " END"
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), '{upper}', '{upper.lower()}') AS t, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT *, regexp_extract(r, '^([^?#]*)', 1) AS w FROM u),
p AS MATERIALIZED (SELECT *, translate(regexp_extract(w, '^([^/]*)', 1), '{upper}', '{upper.lower()}') AS host, substr(w, length(regexp_extract(w, '^([^/]*)', 1)) + 1) AS path FROM h),
k AS (SELECT unnest([{listed(STRICT)}]) AS term, true AS strict UNION ALL SELECT unnest([{listed(SOFT)}]), false),
x AS (SELECT rid, t, unnest(range(1, length(t) + 1)) AS i FROM p),
f AS (SELECT rid, i, term, strict FROM x JOIN k ON substr(t, i, length(term)) = term WHERE NOT regexp_matches(substr(' ' || t, i, 1), '[a-z0-9]') AND NOT regexp_matches(substr(t, i + length(term), 1), '[a-z0-9]')),
c AS (SELECT rid, count(*) FILTER (strict) AS n_strict, count(DISTINCT term) FILTER (NOT strict) AS n_soft FROM f GROUP BY rid)
SELECT page_id, host, path, {which(lambda h, p, v: h + p)} AS rule,
  coalesce({which(lambda h, p, v: v)}, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n_strict, 0)::BIGINT AS n_strict, coalesce(n_soft, 0)::BIGINT AS n_soft
FROM p LEFT JOIN c USING (rid)
"""


SQL = _sql()
