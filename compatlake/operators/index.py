"""A stored full-text index: postings in blocks with bounds, kept current by merging changed documents alone.

Every document has a number, given once. The postings of a word are cut into blocks of ``BLOCK`` consecutive numbers, so
blocks of different words with one number speak of the same documents. A block knows its most occurrences and its shortest
document, which bounds what any of its documents can score. A search first meets these few numbers: it takes the
most promising blocks of each query, and their k-th best document tells which other blocks can still matter. Postings are
read of these alone, so a word that all documents hold does not yield all documents.

A change rewrites the blocks that hold an old or new word of a changed document, as a further version beside the untouched
ones. Readers take the latest version of each block; after ``MOST_PARTS`` changes all are merged into one.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scaling import number_rows, shared_folder, stored, top_rows
from .search import B, K1, LEAST_WEIGHT, LIMIT, MOST, query_phrases
from .versions import Versions

#: Documents that share a block of each of their words.
BLOCK = 1024
#: Blocks of each query that are read to find out how good the best documents are.
FIRST = 2
#: Versions of blocks that are read side by side before they are merged.
MOST_PARTS = 8
#: Up to so many words are named in the scan of blocks, which then passes over the pages of other words; beyond, the join alone selects.
NAMED = 500

_SCORED = ["doc_id", "doc_length", "times"]
_POSTING = ["number", "doc_id", "doc_length", "times", "places"]


class ChangedMeanwhile(RuntimeError):
    """Another writer has published a version; nothing of this change is visible."""


def _bound(most: Column, least: Column, average: Column | float) -> Column:
    """What a word's occurrences count in a document of some length, before the weight of the word."""
    return most * (K1 + 1.0) / (most + K1 * (1.0 - B + B * (least / average)))


def _tokenised(docs: DataFrame, text: Column) -> DataFrame:
    found = docs.select("doc_id", text.alias("_tokens"))
    return found.withColumn("doc_length", F.size(F.filter("_tokens", lambda token: token != F.lit(""))))


def _postings(numbered: DataFrame) -> DataFrame:
    """Word, block and posting of each word of numbered documents, with all its places; dealt by ranges of word and block."""
    places = numbered.select("number", "doc_id", "doc_length", F.posexplode("_tokens").alias("at", "token"))
    places = places.where("token <> ''").withColumn("block", F.expr(f"number div {BLOCK}")).repartitionByRange("token", "block")
    found = places.groupBy("token", "block", "number", "doc_id", "doc_length")
    found = found.agg(F.array_sort(F.collect_list("at")).alias("places")).withColumn("times", F.size("places"))
    return found.select("token", "block", F.struct(*_POSTING).alias("posting"))


def _described(blocks: DataFrame) -> DataFrame:
    """Blocks (token, block, postings) with what a search needs to know of them beforehand."""
    ids = F.transform("postings", lambda posting: posting["doc_id"])
    return blocks.select(
        "token",
        "block",
        F.size("postings").alias("documents"),
        F.array_max(F.transform("postings", lambda posting: posting["times"])).alias("most"),
        F.array_min(F.transform("postings", lambda posting: posting["doc_length"])).alias("least"),
        F.array_min(ids).alias("first_doc"),
        "postings",
    )


class SearchIndex:
    """An index of documents ``(doc_id, text)`` in a folder which all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)

    # --- tables --------------------------------------------------------------------------------

    def _parts(self, name: str, state: dict, named: list[str] | None = None) -> DataFrame:
        """A table's rows of all versions that are read side by side; those of some words only, if these are named."""
        found = None
        for at, part in enumerate(state["parts"]):
            rows = self.spark.read.parquet(f"{self.root}/{name}-{part}")
            if named is not None:
                rows = rows.where(F.col("token").isin(named))
            rows = rows.withColumn("part", F.lit(at))
            found = rows if found is None else found.unionByName(rows)
        return found

    def _blocks(self, state: dict, words: DataFrame | None = None, named: list[str] | None = None) -> DataFrame:
        """What is known of the current blocks, of some words or all; no postings."""
        found = self._parts("blocks", state, named).select("token", "block", "documents", "most", "least", "first_doc", "part")
        if words is not None:
            found = found.join(words, "token", "left_semi")
        if len(state["parts"]) > 1:
            own = F.struct("documents", "most", "least", "first_doc", "part")
            found = found.groupBy("token", "block").agg(F.max_by(own, "part").alias("own")).select("token", "block", "own.*")
        return found.where("documents > 0")

    def documents(self, state: dict | None = None) -> DataFrame:
        """The documents that the index holds: doc_id, number, doc_length and words."""
        state = state or self.versions.latest()[1]
        found = self._parts("documents", state)
        if len(state["parts"]) > 1:
            own = F.struct("number", "doc_length", "words", "gone")
            found = found.groupBy("doc_id").agg(F.max_by(own, "part").alias("own")).select("doc_id", "own.*")
        return found.where("NOT gone").select("doc_id", "number", "doc_length", "words")

    # --- writing -------------------------------------------------------------------------------

    def _write(self, blocks: DataFrame, documents: DataFrame, dealt: bool = False) -> str:
        """Both tables in folders of their own; blocks sorted by word, so that row groups can be passed over.

        ``dealt``: blocks lie in ranges of word and block already.
        """
        part = uuid.uuid4().hex
        blocks = blocks if dealt else blocks.repartitionByRange("token", "block")
        blocks.sortWithinPartitions("token", "block").write.parquet(f"{self.root}/blocks-{part}")
        documents.write.parquet(f"{self.root}/documents-{part}")
        return part

    def _delete(self, part: str) -> None:
        self.versions.delete(f"blocks-{part}")
        self.versions.delete(f"documents-{part}")

    def _publish(self, version: int, state: dict) -> None:
        if not self.versions.publish(version + 1, state):
            for part in set(state["parts"]) - set(self.versions.latest()[1].get("parts", [])):
                self._delete(part)
            raise ChangedMeanwhile(f"version {version + 1} of the index was published by another writer")

    def build(self, docs: DataFrame, text: Column) -> None:
        """A first version, or a new one in place of all that is there. ``doc_id`` tells documents apart."""
        version, _ = self.versions.latest()
        numbered = number_rows(_tokenised(docs, text), [], [F.col("doc_id").asc()], "number")
        numbered = stored(numbered.withColumn("number", F.col("number") - 1))
        blocks = _postings(numbered).groupBy("token", "block").agg(F.array_sort(F.collect_list("posting")).alias("postings"))
        words = F.array_except(F.array_distinct("_tokens"), F.array(F.lit("")))
        documents = numbered.select("doc_id", "number", "doc_length", words.alias("words"), F.lit(False).alias("gone"))
        part = self._write(_described(blocks), documents, dealt=True)
        totals = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("words")).first()
        state = {"parts": [part], "documents": totals["n"], "words": totals["words"], "next": totals["n"]}
        self._publish(version, state)

    def update(self, changed: DataFrame, text: Column, removed: DataFrame | None = None) -> None:
        """Take in new and changed documents, and leave out removed ones ``(doc_id)``; only their blocks are written.

        A document must not be in both. Those to be removed need not be in the index.
        """
        version, state = self.versions.latest()
        tokenised = stored(_tokenised(changed, text))
        ids = tokenised.select("doc_id")
        if removed is not None:
            ids = ids.unionByName(removed.select("doc_id"))
        old = stored(self.documents(state).join(ids, "doc_id", "left_semi"))
        known = tokenised.join(old.select("doc_id", "number"), "doc_id")
        fresh = number_rows(tokenised.join(old, "doc_id", "left_anti"), [], [F.col("doc_id").asc()], "number")
        fresh = fresh.withColumn("number", F.col("number") - 1 + F.lit(state["next"]))
        numbered = stored(known.unionByName(fresh))

        block = F.expr(f"number div {BLOCK}").alias("block")
        touched = old.select(block, "number").groupBy("block").agg(F.collect_list("number").alias("numbers"))
        added = _postings(numbered).groupBy("token", "block").agg(F.collect_list("posting").alias("added"))
        keys = old.select(F.explode("words").alias("token"), block).distinct()
        meta = self._blocks(state, keys.select("token").unionByName(added.select("token")).distinct())
        kept = keys.unionByName(added.select("token", "block")).distinct().join(meta, ["token", "block"])
        kept = self._with_postings(state, kept.select("token", "block", "part")).join(touched, "block", "left")
        none = F.array().cast("array<bigint>")
        kept = kept.withColumn(
            "postings", F.filter("postings", lambda p: ~F.array_contains(F.coalesce("numbers", none), p["number"]))
        )
        both = kept.select("token", "block", "postings").join(added, ["token", "block"], "full")
        empty = F.array().cast(both.schema["postings"].dataType)
        blocks = both.select(
            "token", "block",
            F.array_sort(F.concat(F.coalesce("postings", empty), F.coalesce("added", empty))).alias("postings"),
        )
        words = F.array_except(F.array_distinct("_tokens"), F.array(F.lit("")))
        documents = numbered.select("doc_id", "number", "doc_length", words.alias("words"), F.lit(False).alias("gone"))
        gone = old.join(tokenised, "doc_id", "left_anti").withColumn("gone", F.lit(True))
        part = self._write(_described(blocks), documents.unionByName(gone))

        sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("words")]
        less, more = old.agg(*sums).first(), numbered.agg(*sums).first()
        new = numbered.where(F.col("number") >= state["next"]).count()
        state = {
            "parts": [*state["parts"], part],
            "documents": state["documents"] - less["n"] + more["n"],
            "words": state["words"] - less["words"] + more["words"],
            "next": state["next"] + new,
        }
        if len(state["parts"]) > MOST_PARTS:
            state = self._merged(state)
            self._delete(part)
        self._publish(version, state)

    def _merged(self, state: dict) -> dict:
        """All versions of blocks written as one."""
        blocks = self._with_postings(state, self._blocks(state).select("token", "block", "part"))
        documents = self.documents(state).withColumn("gone", F.lit(False))
        return {**state, "parts": [self._write(_described(blocks), documents)]}

    def expire(self, keep: int = 1) -> None:
        """Delete tables that none of the latest ``keep`` versions reads."""
        numbers = self.versions.numbers()
        used = {part for number in numbers[-keep:] for part in self.versions.read(number)["parts"]}
        old = {part for number in numbers[:-keep] for part in self.versions.read(number)["parts"]} - used
        for number in numbers[:-keep]:
            self.versions.delete("versions", f"{number}.json")
        for part in old:
            self._delete(part)

    # --- searching -----------------------------------------------------------------------------

    def _with_postings(self, state: dict, blocks: DataFrame, named: list[str] | None = None) -> DataFrame:
        """Postings of chosen blocks ``(token, block, part)``."""
        return self._parts("blocks", state, named).select("token", "block", "part", "postings").join(blocks, ["token", "block", "part"])

    def _phrases(self, state: dict, steps: DataFrame, meta: DataFrame, named: list[str] | None) -> DataFrame:
        """Blocks of phrases as if they were words: documents in which all steps start at one place."""
        steps = steps.where("length > 1").select("term", "length", "step", "token").distinct()
        each = steps.select("term", "length", "token").distinct()
        shared = each.join(meta, "token").groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"))
        wanted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        shared = shared.join(wanted, ["term", "n"]).select("term", "block")
        chosen = meta.join(each.join(shared, "term").select("token", "block").distinct(), ["token", "block"])
        rows = self._with_postings(state, chosen.select("token", "block", "part"), named)
        rows = rows.join(steps, "token").join(shared, ["term", "block"]).repartition("term", "block")
        rows = rows.select("term", "block", "length", "step", F.explode("postings").alias("p"))
        starts = rows.select("term", "block", "length", "p.number", "p.doc_id", "p.doc_length", "step", F.explode("p.places").alias("at"))
        found = starts.groupBy("term", "block", "number", "doc_id", "doc_length", "length", (F.col("at") - F.col("step")).alias("start"))
        found = found.agg(F.count(F.lit(1)).alias("steps")).where("steps = length")
        found = found.groupBy("term", "block", "number", "doc_id", "doc_length").agg(
            F.count(F.lit(1)).cast("int").alias("times"), F.array_sort(F.collect_list("start")).alias("places")
        )
        blocks = found.groupBy(F.col("term").alias("token"), "block").agg(
            F.array_sort(F.collect_list(F.struct(*_POSTING))).alias("postings")
        )
        return _described(blocks)

    def search(self, queries: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
        """Best documents per query ``(query_id, query)``: all words present, BM25 descending, then document id."""
        limit = min(limit, most)
        state = self.versions.latest()[1]
        average = state["words"] / state["documents"] if state["documents"] else 1.0
        steps = query_phrases(queries)
        term = F.array_join(F.array_agg("token").over(Window.partitionBy("query_id", "phrase").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " ")
        steps = stored(steps.withColumn("term", term))
        words = steps.select("token").distinct()
        named = [row["token"] for row in words.limit(NAMED + 1).collect()]
        named = named if len(named) <= NAMED else None
        meta = stored(self._blocks(state, words, named))
        known, phrases = meta, None
        if not steps.where("length > 1").isEmpty():
            phrases = stored(self._phrases(state, steps, meta, named))
            single = steps.where("length = 1").select(F.col("term").alias("token")).distinct()
            known = meta.join(single, "token", "left_semi")
            known = stored(known.unionByName(phrases.drop("postings").withColumn("part", F.lit(-1))))
        known = known.withColumnRenamed("token", "term")

        containing = known.groupBy("term").agg(F.sum("documents").alias("containing"))
        weight = F.greatest(
            F.ln((state["documents"] - F.col("containing") + 0.5) / (F.col("containing") + 0.5)), F.lit(LEAST_WEIGHT)
        )
        terms = steps.groupBy("query_id", "term").agg(F.count_distinct("phrase").alias("said"))
        terms = stored(terms.join(containing, "term").withColumn("weight", weight * F.col("said")))
        own = Window.partitionBy("query_id")
        asked = steps.groupBy("query_id").agg(F.count_distinct("term").alias("wanted"))
        rarest = terms.withColumn("_n", F.row_number().over(own.orderBy("containing", "term"))).where("_n = 1")
        pairs = rarest.select("query_id", "term").join(known.select("term", "block"), "term").select("query_id", "block")
        each = pairs.join(terms.select("query_id", "term", "weight"), "query_id").join(known, ["term", "block"])
        bound = F.sum(F.col("weight") * _bound(F.col("most"), F.col("least"), average))
        places = each.groupBy("query_id", "block").agg(
            F.round(bound + 1e-9, 6).alias("bound"), F.count(F.lit(1)).alias("wanted"), F.max("first_doc").alias("first_doc")
        )
        places = stored(places.join(asked, ["query_id", "wanted"]).drop("wanted"))

        def evaluated(chosen: DataFrame) -> DataFrame:
            """Scores of the documents of some blocks of queries."""
            rows = chosen.select("query_id", "block").join(terms.select("query_id", "term", "weight"), "query_id")
            rows = rows.join(known.select("term", "block", "part"), ["term", "block"])
            # plain lists of what is scored take a fraction of whole postings, and places are not read
            lists = [F.col(f"postings.{name}").alias(name) for name in _SCORED]
            held = self._parts("blocks", state, named).select(F.col("token").alias("term"), "block", "part", *lists)
            if phrases is not None:
                held = held.unionByName(phrases.select(F.col("token").alias("term"), "block", F.lit(-1).alias("part"), *lists))
            rows = held.join(rows, ["term", "block", "part"]).repartition("query_id", "block")
            rows = rows.select("query_id", "block", "weight", F.explode(F.arrays_zip(*_SCORED)).alias("p"))
            part = F.col("weight") * _bound(F.col("p.times"), F.col("p.doc_length"), average)
            found = rows.groupBy("query_id", "block", F.col("p.doc_id").alias("doc_id")).agg(
                F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("wanted")
            )
            return found.join(asked, ["query_id", "wanted"]).select("query_id", "doc_id", "score")

        promising = top_rows(places, ["query_id"], [F.col("bound").desc(), F.col("first_doc").asc(), F.col("block").asc()], FIRST, "_n").drop("_n")
        order = [F.col("score").desc(), F.col("doc_id").asc()]
        best = stored(top_rows(evaluated(promising), ["query_id"], order, limit))
        last = best.where(F.col("rank") == limit).select("query_id", F.col("score").alias("_score"), F.col("doc_id").alias("_doc"))
        rest = places.join(promising.select("query_id", "block"), ["query_id", "block"], "left_anti").join(last, "query_id", "left")
        rest = rest.where(
            "_score IS NULL OR bound > _score OR (bound = _score AND first_doc <= _doc)"
        )
        more = evaluated(rest)
        return top_rows(best.drop("rank").unionByName(more), ["query_id"], order, limit)


def index_of(docs: DataFrame, text: Column, name: str) -> SearchIndex:
    """The index of some files' documents, built when it is asked for first and kept until the application ends.

    ``name`` stands for how documents and ``text`` follow from the files; the files' names, sizes and times are looked at.
    """
    spark = docs.sparkSession
    seen = []
    for file in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    key = hashlib.sha256("\n".join([spark.sparkContext.applicationId, name, *seen]).encode()).hexdigest()[:32]
    root = f"{shared_folder(spark)}/index-{key}"
    index = SearchIndex(spark, root)
    if not index.versions.numbers():
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        try:
            index.build(docs, text)
        except ChangedMeanwhile:
            pass
    return index
