"""From raw documents to encoded training text: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet
in the shared folder and rereads them, so that a lost executor costs at most one stage's tasks, and
deletes what a stage wrote on its way once its rows are there.

Defined results: a null or empty text has no letter and goes in the first stage; very long texts go
through every stage whole; of repeated rows one stays; rows with a null id are documents like others
and told apart by their texts; an empty table gives an empty one; further columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitforge.llm.bpe import encode_documents, tokenizer_path
from traitforge.llm.common import materialize, table, text_print
from traitforge.llm.decontaminate import remove_contamination
from traitforge.llm.language import keep_identified, learn_languages
from traitforge.llm.minhash import NearDuplicates
from traitforge.llm.suffix_dedup import remove_repeats
from traitforge.plans.storage import release, written

#: Mean word probability of the best language below which a document is rejected. With the four
#: languages of the test tables, of documents that the model was not learned from the lowest score
#: is 0.48, one in a thousand is under 0.63; words of random letters score 0.29 to 0.45, and texts
#: half in one language and half in another 0.5, which stay. With two languages nothing scores less.
LEAST_LANGUAGE_SCORE = 0.45


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model recognises; texts without letters go, and so do texts
    whose words are of no learned language."""
    return keep_identified(docs, learn_languages(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    groups = materialize(NearDuplicates(docs, width=5, percent=80).groups(), "groups")
    key = text_print(F.col("text"))
    same = lambda t: docs["doc_id"].eqNullSafe(t["id"]) & (key == t["print"])
    gone = groups.filter("NOT leader").select("id", "print").distinct()
    kept = docs.join(gone, same(gone), "left_anti")
    # Rows that repeat a leader's id and text are the same document once more.
    again = groups.filter("leader AND n > 0").groupBy("id", "print").count().filter("count > 1").select("id", "print")
    if again.isEmpty():
        return kept
    return kept.join(again, same(again), "left_anti").unionByName(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of byte strings that repeat across documents or in one are cut out; documents
    of which nothing but white space stays go."""
    kept = remove_repeats(docs, keep="first")
    return kept.filter(F.col("text").rlike(r"(?U)\S"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly are such passages go."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, in decimal, with their number and digests."""
    found = encode_documents(docs, tokenizer_path())
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("encoding", encode),
]

#: The stages are tested against brute force: SQL has no conditional random field and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep_last=True)
    return docs
