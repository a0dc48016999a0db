"""Full-text search for many queries at once: every word required, ranked by BM25."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from .scaling import sliced_join, stored, top_rows

# BM25 parameters, the smallest weight of a word, and result limits.
K1, B = 1.2, 0.75
LEAST_WEIGHT = 1e-6
LIMIT, MOST = 20, 100
#: Words of documents that meet words of queries in one task.
HITS = 500_000
#: Names that meet a part in one task.
MEETINGS = 2_000_000
#: Small Latin letters with marks of all blocks, by their canonical decomposition, and the letters they are searched as.
_FOLDS = {
    chr(code): unicodedata.normalize("NFD", chr(code))[0]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if chr(code) == chr(code).lower() and unicodedata.normalize("NFD", chr(code))[0] in string.ascii_lowercase
}
_MARKED, _PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without marks on Latin letters, be they of one piece or combined."""
    plain = F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{Mn}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda token: token != "")


def field_tokens(*fields: Column) -> Column:
    """Tokens of several fields, with an empty place between fields so that no phrase spans two."""
    parts: list[Column] = []
    for at, field in enumerate(fields):
        if at:
            parts.append(F.array(F.lit("")))
        parts.append(tokens(F.coalesce(field, F.lit(""))))
    return F.concat(*parts)


def postings(docs: DataFrame, text: Column) -> DataFrame:
    """Token, document and number of occurrences."""
    found = docs.select("doc_id", F.explode(text).alias("token")).where(F.col("token") != "")
    return found.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("occurrences"))


def vocabulary(docs: DataFrame, text: Column) -> DataFrame:
    """Documents and occurrences per token."""
    return (
        postings(docs, text)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("occurrences").alias("occurrences"))
    )


def query_phrases(queries: DataFrame) -> DataFrame:
    """Tokens of each query's words; a word of several tokens is a phrase of them in a row."""
    split = F.filter(F.split("query", " "), lambda word: word != "")
    phrases = queries.select("query_id", F.posexplode(split).alias("phrase", "word")).withColumn(
        "_tokens", tokens(F.col("word"))
    )
    sized = phrases.withColumn("length", F.size("_tokens")).where(F.col("length") > 0)
    return sized.select("query_id", "phrase", "length", F.posexplode("_tokens").alias("step", "token"))


def search(docs: DataFrame, text: Column, queries: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """Best documents per query ``(query_id, query)``: all words present, BM25 descending, then document id.

    Documents meet the queries' tokens word by word, and whole texts are not shuffled. At most ``most`` results are
    given, whatever the limit asks for.
    """
    tokenised = docs.select("doc_id", text.alias("_tokens"))
    length = F.size(F.filter("_tokens", lambda token: token != F.lit("")))
    totals = tokenised.agg(F.count(F.lit(1)).alias("docs"), F.sum(length).alias("words"))
    doc_count = totals.select("docs").scalar()
    word_count = totals.select("words").scalar()

    steps = stored(query_phrases(queries))
    wanted = steps.groupBy("query_id").agg(F.count_distinct("phrase").alias("_wanted"))
    places = tokenised.select("doc_id", length.alias("doc_length"), F.posexplode("_tokens").alias("at", "token"))
    # a single token counts wherever it is; a phrase counts where all its steps start at one place
    start = F.when(F.col("length") > 1, F.col("at") - F.col("step")).otherwise(F.lit(0))
    group = ["query_id", "phrase", "doc_id"]
    # words that no query has are left out first; documents with a word of many are dealt out over slices
    places = stored(places.join(steps.select("token").distinct(), "token", "left_semi"))
    counted = stored(places.groupBy("token").agg(F.count(F.lit(1)).alias("_rows")))
    said = steps.groupBy("token").agg(F.count(F.lit(1)).alias("_said"))
    all_hits = counted.join(said, "token").agg(F.sum(F.col("_rows") * F.col("_said"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-all_hits // HITS))
    hits = (
        sliced_join(places, steps, ["token"], ["doc_id"], counted)
        .repartition(tasks, "query_id", "doc_id")
        .groupBy(*group, "doc_length", "length", start.alias("_start"))
        .agg(F.count(F.lit(1)).alias("_steps"))
    )
    times = F.when(F.col("length") == 1, F.col("_steps")).otherwise((F.col("_steps") == F.col("length")).cast("bigint"))
    found = stored(
        hits.groupBy(*group, "doc_length").agg(F.sum(times).alias("times")).where(F.col("times") > 0)
    )
    spread = stored(found.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("_containing")))
    weight = F.greatest(
        F.ln((doc_count - F.col("_containing") + 0.5) / (F.col("_containing") + 0.5)), F.lit(LEAST_WEIGHT)
    )
    relative = F.col("doc_length") / (word_count / doc_count)
    part = weight * (F.col("times") * (K1 + 1.0)) / (F.col("times") + K1 * (1.0 - B + B * relative))
    scored = (
        sliced_join(found, spread, ["query_id", "phrase"], ["doc_id"], spread.withColumn("_rows", F.col("_containing")))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("_found"))
        .join(wanted, "query_id")
        .where(F.col("_found") == F.col("_wanted"))
        .select("query_id", "doc_id", "score")
    )
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], min(limit, most))


def with_games(hits: DataFrame, reports: DataFrame, games: DataFrame) -> DataFrame:
    """Search hits on reports (``doc_id``) with the game each report is about; the name is NULL for an unknown game."""
    return hits.join(reports.select("doc_id", "appid"), "doc_id").join(games.select("appid", "name"), "appid", "left")


def name_contains(names: DataFrame, part: str) -> DataFrame:
    """Rows whose name holds a text in any case."""
    return names.where(F.lower("name").contains(part.lower()))


#: Letters of the pieces under which names are found.
GRAM = 3


def _grams(text: Column, least: int = 1) -> Column:
    """Distinct pieces of up to three letters that start anywhere in a text, of at least so many letters."""
    places = F.sequence(F.lit(1), F.length(text))

    def pieces(size: int) -> Column:
        cut = F.transform(places, lambda at: F.substring(text, at, F.lit(size)))
        return F.filter(cut, lambda piece: F.length(piece) == size)

    found = F.array_distinct(F.concat(*[pieces(size) for size in range(least, GRAM + 1)]))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<string>"))


def names_containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs of a name ``(doc_id, name)`` and a part ``(part_id, part)`` that it holds in any case.

    Names are found under their pieces of one to three letters: a part meets those under the rarest of its own
    three-letter pieces (under itself, if it is shorter), and these are looked at in full. Pieces are counted first, so that
    names are shuffled only under pieces that are the rarest of some part, by as many tasks as there are meetings to make.
    An empty part is in every name, and meets all of them.
    """
    parts = stored(parts.select("part_id", "part", F.lower("part").alias("_part")).where("part IS NOT NULL"))
    own = F.when(F.length("_part") >= GRAM, _grams(F.col("_part"), GRAM)).otherwise(F.array("_part"))
    pieces = parts.select("part_id", "part", "_part", F.explode(own).alias("gram"))
    low = names.select("doc_id", "name", F.lower("name").alias("_name")).where("name IS NOT NULL")
    found = low.select("doc_id", "name", F.explode(F.concat(_grams(F.col("_name")), F.array(F.lit("")))).alias("gram"))
    counted = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows")).join(pieces.select("gram").distinct(), "gram", "left_semi"))
    rarest = pieces.join(counted, "gram", "left").groupBy("part_id", "part", "_part").agg(
        F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("rows"), "gram")).alias("own")
    )
    asked = stored(rarest.where("own.rows > 0").select("part_id", "part", "_part", F.col("own.gram").alias("gram")))
    meetings = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("_parts")).join(counted, "gram")
    meetings = stored(meetings.select("gram", (F.col("_rows") * F.col("_parts")).alias("_rows")))
    tasks = -(-(meetings.agg(F.sum("_rows")).first()[0] or 0) // MEETINGS)
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, tasks)
    found = found.join(meetings.select("gram"), "gram", "left_semi")
    pairs = sliced_join(found, asked, ["gram"], ["doc_id"], meetings, tasks=tasks)
    return pairs.where(F.lower("name").contains(F.col("_part"))).select("part_id", "part", "doc_id", "name")
