"""What several operators need: input columns, held results and the vocabulary files."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text (null: empty) under fixed names; other columns cannot clash with later ones."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def through_python(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with whole numbers of the named columns as text: where one is null, pandas would round the others beyond 2 ** 53."""
    whole = ("tinyint", "smallint", "int", "bigint")
    return df.withColumns({n: F.col(n).cast("string") for n in names if df.schema[n].dataType.simpleString() in whole})


def lot(key: Column, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``: the seeded split of the operators that learn."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, shared by all executors: the session's ``spark.checkpoint.dir``.

    A temporary one is set only in a one-process session that has none, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: it survives lost executors and is not computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after the package's code has been sent to the executors, once per application, for functions that run in Python."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return df


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
