"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
LANGS = ("en", "de", "fr", "es", "it", "pt", "nl")

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for was as with be on by at have are this not or had from but they an were which one you all has been will would more when there can if some what so out up into than them only other about before most after nobody every without",
    "de": "der die das und in zu den von ist mit sich des auf für nicht ein eine dem als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir uns sehr wenn niemand warum doch weil",
    "fr": "le la les de des du et à un une est en que qui dans ce il elle au pour pas sur par plus ne se avec sont cette mais son nous vous on ou été aux sa ses comme tout même après avant si dont leur sans être fait cela ici très où parce",
    "es": "el la los las de y en que a un una es por con no se para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra ese eso ha está fue son así antes aunque",
    "it": "il la le i gli lo di e in che a un una è per con non si da del della dei delle al alla come più o ma anche sono nel nella dal questo questa se ci molto dopo prima stato fu ha senza perché quando cosa tra su sul ogni dalla negli agli",
    "pt": "o a os as de e em que um uma é por com não se para do da dos das no na nos nas ao mais como mas foi ou seu sua ele ela são está também muito depois antes sem porque quando isso este esta até pela pelo já entre todos às nós tem",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over ze hij naar heeft had of wel geen werd wordt worden dit die zo heel na zonder meer wij je kun moet omdat wat deze hebben was tot",
}
FUNCTION_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

# Spellings of language labels.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands",
}
_LABEL = {x: k for k, v in LABELS.items() for x in v.split()}


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, in whatever spelling; None where it names none of ours."""
    if not label:
        return None
    s = unicodedata.normalize("NFC", label).strip().lower()
    return _LABEL.get(s) or _LABEL.get(re.split(r"[-_. ]", s)[0])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. On one machine (local masters) a folder of its own
    will do where none is named; on a cluster that would be lost with the machine, and is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder and cut the lineage (survives the loss of executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a table in the shared folder: compressed, and read by column. Survives the loss of executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter. Its size does not grow with the data: a fuller filter lets more pass, and nothing is lost.
FILTER_BITS = 1 << 24
_IN_ROW = 32768


def bit_filter(values: DataFrame, col: str) -> np.ndarray:
    """A bitmap (2 MB) of the values of a bigint column. Every value is found in it, and few that were not there."""
    x = F.pmod(F.col(col), F.lit(FILTER_BITS)) + 1
    rows = values.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("b"))
    out = np.zeros((FILTER_BITS // _IN_ROW, _IN_ROW // 8), np.uint8)
    for r in rows.collect():  # at most 512 rows of 4 KB
        out[r["k"] - 1] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = np.mod(values, FILTER_BITS)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def spread(df: DataFrame) -> DataFrame:
    """Small inputs come in fewer splits than there are cores; then the rows are dealt out, or one core would do the
    work of all. Results do not depend on it; operators take `spread_rows=False` to read every input as it is split."""
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df


def bounded_sample(df: DataFrame, k: int, id_col: str) -> DataFrame:
    """At most k rows, those of the smallest id hash. Rows that cannot be among them (but with a vanishing chance) are left
    out before the sort, so that what is gathered does not grow with the data."""
    h = F.xxhash64(id_col)
    if (n := df.count()) > k:
        share = min(1.0, (k + 6 * k**0.5 + 20) / n)
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), id_col).limit(k)


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch as a dict of Python lists; fn returns a dict of lists in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
