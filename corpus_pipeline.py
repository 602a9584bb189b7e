"""A training-corpus pipeline of five stages over the operators in ``stowage.llm``.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns what it keeps; all but
the last return those columns, extra ones too, whatever their names. ``run`` writes each stage's rows to the shared
folder, reads them for the next, and removes a stage's rows once those of the next are written. The rows of the last but
one stay, as the result that ``run`` returns reads them whenever it is evaluated.

Empty tables stay empty in every stage. Null ids and repeated rows are rows like any other, unless a stage says more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, decontam, langid, linededup, simhash
from stowage.llm.common import crc_mod, remove, shared_dir, table, unpacked, whole_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was identified; texts that are null or hold no letters go.

    Rows of null id are judged but not learnt from. Rows that repeat all stay or all go. Ties between languages do not
    matter here.
    """
    model = langid.learn(docs, lambda c: crc_mod(c, 4) != 2)
    found = langid.predict(whole_rows(docs), model, "_row", "_text", keep_text=True)
    return unpacked(found.where(F.col("lang_pred") != langid.UNKNOWN), "doc_id", "text", docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of a line that ten or more of them hold, only the first one stays in a text.

    The first is that of the smallest id, a null one before all; of equal ids, that of the smaller hash of the text.
    Rows equal in id and text are one document, and lose the same lines.
    """
    return linededup.drop_lines(docs, linededup.keep_bitmaps(docs, min_docs=10, keep_first=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by fingerprints.

    A row of null id stays only in a group without any other; of equal ids, the row of the smaller hash of the text
    stays, and of rows equal in both, one. Null and empty texts, and texts without words, are one group.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none.

    Rows that repeat all stay or all go. An empty benchmark, or one of null texts, keeps all.
    """
    found = decontam.contamination(whole_rows(docs), table(spark, sf_dir, "benchmark"), id_col="_row", text_col="_text", keep_text=True)
    return unpacked(found.where("n_hit = 0"), "doc_id", "text", docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (packed little-endian 32-bit), their count and hash, and the decoded text's hash.

    A row for each row; null and empty texts have no tokens.
    """
    return bpe.encode_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("encoded", encoded)]

#: Language ID, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, paths = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", []
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            paths.append(f"{folder}/{at}-{name}")
            docs.write.parquet(paths[-1])
            docs = spark.read.parquet(paths[-1])
            if at:
                remove(spark, paths[-2])
    return docs
