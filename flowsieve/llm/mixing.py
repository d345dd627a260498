"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a value that the targets do
not list counts as ``other``, so there are at most (sources + 1) x (languages +
1) x (topics + 1) cells whatever the input size.  One pass sums the words per
cell.  Raking then scales the cells' shares in turn until the shares of sources,
languages and topics meet their targets; a share is never raised above what the
cell can give at the sampling rate, so no probability exceeds one.  A document
is taken with its cell's probability, by a draw that its key fixes.

Edge cases: null source, language or topic counts as ``other``; a target
without documents is left out and the others are scaled up; an empty text has no
words, shares its cell's probability and never matters to a share; rows with the
same key share their draw; a null key draws as the text ``null``; if there are
no words at all, every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: The mix of the registered query: shares of words.
TARGETS = {
    "source": {"src0": 0.24, **{f"src{i}": 0.039 for i in range(1, 20)}, "other": 0.019},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.12, "other": 0.01},
    "topic": {"table": 0.05, "note": 0.05, "article": 0.40, "report": 0.30, "book": 0.20},
}
#: Probability of a document whose cell already has its target share.
RATE = 0.8
ROUNDS = 40
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def form(text: str = "text", words: str = "n_words") -> Column:
    """Topic of tables that have none: the form of the text."""
    return (F.when(F.col(text).contains(" | "), "table").when(F.col(words) < 50, "note")
            .when(F.col(words) < 500, "article").when(F.col(words) < 2000, "report").otherwise("book"))


def rake(cells: list[tuple], words: np.ndarray, targets: dict, rate: float = RATE, rounds: int = ROUNDS) -> np.ndarray:
    """Probability of each cell (tuples in the order of ``DIMENSIONS``)."""
    total = words.sum()
    if not len(cells) or total <= 0:
        return np.ones(len(cells))
    natural = words / total
    most = natural / rate
    share = natural.copy()
    groups = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells})
        index = np.array([values.index(c[d]) for c in cells])
        has = np.bincount(index, words) > 0
        goal = np.array([targets[name].get(v, 0.0) for v in values]) * has
        if goal.sum() > 0:
            groups.append((index, goal / goal.sum()))
    for _ in range(rounds):
        for index, goal in groups:
            now = np.bincount(index, share)
            share = share * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[index]
        share = np.minimum(share, most)
    return np.where(natural > 0, np.minimum(rate * share / np.where(natural > 0, natural, 1), 1), rate)


def draw(key: str) -> Column:
    """Uniform number in [0, 1) that the key fixes."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"-{SEED}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS,
                key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
                topic: Column | None = None, carry: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic`` (as classes), ``n_words, probability, selected`` of every row.

    ``carry`` adds the whole input row as ``row``.
    """
    targets = targets or TARGETS
    spark = docs.sparkSession
    row = [whole_row(docs).alias("row")] if carry else []
    rows = docs.select(*row, F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                       *([topic.alias("topic")] if topic is not None else []))
    rows = rows.withColumn("n_words", n_words())
    if topic is None:
        rows = rows.withColumn("topic", form())

    def listed(name: str) -> Column:
        return F.when(F.col(name).isin(*targets[name]), F.col(name)).otherwise("other").alias(name)

    rows = rows.select(*["row"] * carry, "doc_id", *[listed(d) for d in DIMENSIONS], "n_words")
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_words").alias("n")).collect()  # bounded by the targets
    names = [tuple(c[d] for d in DIMENSIONS) for c in cells]
    chance = rake(names, np.array([c["n"] for c in cells], float), targets, rate, rounds)
    table = spark.createDataFrame([(*n, float(p)) for n, p in zip(names, chance)],
                                  "source string, lang string, topic string, probability double")
    return (rows.join(F.broadcast(table), list(DIMENSIONS), "left")
            .withColumn("selected", draw("doc_id") < F.col("probability")))


def sample(docs: DataFrame, **mix) -> DataFrame:
    """The selected rows of ``docs``, columns as they were."""
    return mix_sources(docs, carry=True, **mix).filter("selected").select("row.*")


def _values(name: str, shares: dict) -> str:
    return ", ".join(f"('{name}', '{v}', {x}::double)" for v, x in shares.items())


def oracle(targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB SQL."""
    targets = targets or TARGETS

    def listed(name: str) -> str:
        return f"CASE WHEN {name} IN ({', '.join(repr(v) for v in targets[name])}) THEN {name} ELSE 'other' END AS {name}"

    steps, goals = [], []
    before = "start"
    for d in DIMENSIONS:
        goals.append(f"""goal_{d} AS MATERIALIZED (SELECT v, x / sum(x) OVER () AS goal FROM targets
            WHERE dim = '{d}' AND v IN (SELECT {d} FROM cells GROUP BY {d} HAVING sum(n) > 0))""")
    fields = "source, lang, topic, base"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"r{i}_{d}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT {fields},
                CASE WHEN sum(share) OVER (PARTITION BY {d}) > 0
                THEN share * coalesce(goal, 0) / sum(share) OVER (PARTITION BY {d}) ELSE 0 END AS share
                FROM {before} LEFT JOIN goal_{d} ON {d} = v)""")
            before = name
        steps.append(f"r{i} AS MATERIALIZED (SELECT {fields}, least(share, base / {rate}) AS share FROM {before})")
        before = f"r{i}"
    return f"""WITH words AS MATERIALIZED (
        SELECT doc_id, coalesce(text, '') AS text, source, lang,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words FROM documents),
    docs AS MATERIALIZED (
        SELECT doc_id, {listed('source')}, {listed('lang')}, n_words,
               CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_words < 50 THEN 'note'
                    WHEN n_words < 500 THEN 'article' WHEN n_words < 2000 THEN 'report' ELSE 'book' END AS topic
        FROM words),
    targets(dim, v, x) AS (VALUES {', '.join(_values(d, targets[d]) for d in DIMENSIONS)}),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_words)::double AS n FROM docs GROUP BY ALL),
    start AS MATERIALIZED (SELECT source, lang, topic, n / sum(n) OVER () AS base, n / sum(n) OVER () AS share FROM cells),
    {', '.join(goals)}, {', '.join(steps)}
    SELECT doc_id, source, lang, topic, n_words::bigint AS n_words,
           round(CASE WHEN base > 0 THEN least({rate} * share / base, 1) ELSE {rate} END, 6) AS probability,
           ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '-{SEED}'), 1, 8))::bigint / 4294967296.0
               < CASE WHEN base > 0 THEN least({rate} * share / base, 1) ELSE {rate} END AS selected
    FROM docs JOIN {before} USING (source, lang, topic)"""
