"""The inverted index as tables: postings, documents, vocabulary and corpus averages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators.dictionary import Words, equal_to_some, grams_of, stems_of, write_sorted
from quillstack.operators.links import link_counts
from quillstack.operators.positions import Places, store_places
from quillstack.scratch import exists


@dataclass
class Index:
    """postings: term, note_id, tf_title, tf_body, tf_tag. docs: a row for each note with its lengths and
    filter columns. words: the vocabulary (term, df, stem) with its tables by stem and by trigram. stats: one
    row with n and the mean field lengths. key: by which columns postings and docs belong together. places: where
    runs of letters stand, if the index has that; without it phrases are looked for in all texts that score."""

    postings: DataFrame
    docs: DataFrame
    words: Words
    stats: DataFrame
    key: list[str] = field(default_factory=lambda: ["note_id"])
    places: Places | None = None

    @property
    def vocab(self) -> DataFrame:
        return self.words.vocab

    def cache(self) -> Index:
        words = Words(*(x.cache() for x in (self.words.vocab, self.words.stems, self.words.grams)), self.words.stale)
        places = self.places and Places(self.places.runs.cache(), self.places.words.cache())
        return Index(self.postings.cache(), self.docs.cache(), words, self.stats.cache(), self.key, places)

    def looked_up(self, surfaces: DataFrame, at_hand: bool, carried: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Postings with df, the term as surface; read no further than the surfaces reach, if they are at hand. carried: how the surfaces are taken to them."""
        post, vocab, asked = self.postings, self.vocab.select("term", "df"), surfaces.select(F.col("surface").alias("term"))
        if at_hand:
            some = sorted({r["term"] for r in asked.collect()})
            near, asked = equal_to_some(F.col("term"), some), surfaces.sparkSession.createDataFrame([(x,) for x in some], "term string")
            post, vocab = post.where(near), vocab.where(near)
        named = vocab.join(asked if at_hand else carried(asked.distinct()), "term")
        return post.join(carried(named), "term").withColumnRenamed("term", "surface")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        of = lambda name: spark.read.parquet(f"{path}/{name}")
        places = Places.read(spark, path) if exists(spark, f"{path}/run_words/_SUCCESS") else None
        return cls(of("postings"), of("docs"), Words(of("vocab"), of("stems"), of("grams")), of("stats"), places=places)


def tag_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.replace(t, F.lit("/"), F.lit(" "))), " ")


def tokens(notes: DataFrame) -> DataFrame:
    """note_id, field (title, body, tag), term: every word and part of a word of every field."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), x.alias("text")) for k, x in (("title", F.col("title")), ("body", F.col("body")), ("tag", tag_text(F.col("tags"))))])
    texts = notes.select("note_id", F.explode(fields).alias("f")).select("note_id", "f.field", "f.text")

    def rows(of: DataFrame, words: Column) -> DataFrame:
        return of.select("note_id", "field", F.explode(words).alias("w")).where("w <> ''")

    # Most texts are folded whole, which leaves words where they were; parts are looked for in the words that have
    # any. The few texts for which that doesn't hold go word by word, and through Python where letters fold into several.
    odd = tx.folds_by_word(F.col("text"))
    even = texts.where(~odd)
    whole = rows(even, tx.raw_words(tx.fold("text"))).withColumnRenamed("w", "term")
    cut = rows(even, tx.raw_words(F.col("text"))).where(F.col("w").rlike(tx.HAS_BOUNDARY)).select("note_id", "field", F.explode(tx.compound_parts(F.col("w"))).alias("w"))
    parts = cut.select("note_id", "field", tx.fold("w").alias("term"))
    slow = rows(texts.where(odd), tx.raw_words(F.col("text"))).select("note_id", "field", F.explode(tx.with_parts(F.col("w"))).alias("w"))
    return whole.unionByName(parts).unionByName(slow.select("note_id", "field", tx.fold_udf("w").alias("term"))).where("term <> ''")


def postings(notes: DataFrame) -> DataFrame:
    count = [F.count_if(F.col("field") == k).cast("int").alias(f"tf_{k}") for k in ("title", "body", "tag")]
    return tokens(notes).groupBy("term", "note_id").agg(*count)


def note_columns(notes: DataFrame) -> DataFrame:
    """What filters and scores need of a note besides its words and links."""
    return notes.select(
        "note_id", tx.fold("title").alias("folded_title"), "created_at", "updated_at", "pinned", "archived", F.col("trashed_at").isNotNull().alias("trashed"), "locked", "tags",
        F.col("body").rlike(tx.OPEN_TASK).alias("has_open"), F.col("body").rlike(tx.DONE_TASK).alias("has_done"),
    )


def documents(notes: DataFrame, post: DataFrame) -> DataFrame:
    lens = post.groupBy("note_id").agg(*[F.sum(f"tf_{k}").alias(f"len_{k}") for k in ("title", "body", "tag")])
    cols = note_columns(notes)
    zero = [F.coalesce(f"len_{k}", F.lit(0)).alias(f"len_{k}") for k in ("title", "body", "tag")]
    out = cols.join(link_counts(notes), "note_id").join(lens, "note_id", "left")
    return out.select(*cols.columns, "link_count", *zero)


def vocabulary(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("stem", tx.stem(F.col("term")))


def averages(docs: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    return docs.agg(n.alias("n"), *[F.greatest(F.lit(1.0), F.coalesce(F.sum(f"len_{k}"), F.lit(0)) / n).alias(f"avg_{k}") for k in ("title", "body", "tag")])


def build_index(notes: DataFrame) -> Index:
    """Statistics cover all notes, archived and trashed ones too; filters come later."""
    post = postings(notes)
    docs = documents(notes, post)
    return Index(post, docs, Words.of(vocabulary(post)), averages(docs))


def store_index(notes: DataFrame, path: str, places: bool = False) -> Index:
    """``build_index``, written table by table: each is made from those already written, so texts are tokenised
    once, and plans over the result start from files. Postings and the tables of words lie in order, in
    ranges, so that a search reads what its words need. With ``places`` phrases find their notes by what stands where."""
    spark = notes.sparkSession

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def put_sorted(rows: DataFrame, name: str, *order: str) -> DataFrame:
        write_sorted(rows, f"{path}/{name}", *order)
        return spark.read.parquet(f"{path}/{name}")

    post = put(postings(notes).sortWithinPartitions("term"), "postings")
    docs = put(documents(notes, post), "docs")
    vocab = put_sorted(vocabulary(post), "vocab", "term")
    words = Words(vocab, put_sorted(stems_of(vocab), "stems", "stem", "term"), put_sorted(grams_of(vocab), "grams", "gram", "size", "term"))
    return Index(post, docs, words, put(averages(docs), "stats"), places=store_places(notes, path) if places else None)
