"""Count tables and model states shared by the registered queries of one session."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.operators.cells import CountData, prepare
from tallymix.operators.initial import init_from_labels
from tallymix.plans.mixture import State, start_state, sweep
from tallymix.plans.specs import FITS
from tallymix.sources import counts_from_events
from tallymix.workspace import Workspace

K = 3


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def supplier_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return counts_from_events(joined, "l_suppkey", "p_brand")


def doc_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")
    tokens = read(spark, sf_dir, "documents").select("doc_id", words).where("token <> ''")
    return counts_from_events(tokens, "doc_id", "token")


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_from_events(read(spark, sf_dir, "events"), "user_id", "event_type")


def doc_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the words of each document begin with each letter: clustered by language, short documents sparse."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")
    letters = read(spark, sf_dir, "documents").select("doc_id", words).where("token <> ''")
    return counts_from_events(letters.select("doc_id", F.substring("token", 1, 1).alias("letter")), "doc_id", "letter")


_SOURCES = {
    "supplier_brand": supplier_brand, "doc_token": doc_token, "user_event": user_event, "doc_letter": doc_letter,
}


def _session() -> SparkSession:
    """The running session, also from a thread in which it is not the active one."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@lru_cache(maxsize=None)
def _workspace(app: str) -> Workspace:
    return Workspace(_session())


def workspace(spark: SparkSession) -> Workspace:
    return _workspace(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _prepared(app: str, sf_dir: str, source: str) -> CountData:
    spark = _session()
    return prepare(_SOURCES[source](spark, sf_dir), workspace(spark))


def prepared(spark: SparkSession, sf_dir: str, source: str = "supplier_brand") -> CountData:
    """The laid-out count table; built once per session and data folder."""
    return _prepared(spark.sparkContext.applicationId, sf_dir, source)


def start_labels(data: CountData, k: int = K) -> DataFrame:
    return data.samples.selectExpr("sample_id", f"cast(sample_id % {k} as int) as label")


@lru_cache(maxsize=None)
def _swept(app: str, sf_dir: str, fit: str, n: int, per_sample: bool | None, beta: float) -> State:
    spark = _session()
    data = prepared(spark, sf_dir)
    spec = FITS[fit] if per_sample is None else FITS[fit].per_sample(per_sample)
    if n == 0:
        return start_state(data, spec, init_from_labels(start_labels(data), K), {0: spec.params(k_max=K)})
    before = _swept(app, sf_dir, fit, n - 1, per_sample, beta)
    return sweep(data, spec, before, beta, gated=fit != "ssl_excess" or n > 1)


def swept(spark: SparkSession, sf_dir: str, fit: str, n: int, per_sample: bool | None = None, beta: float = 1.0) -> State:
    """State of a fit after ``n`` sweeps from labels ``sample_id % K``; built once per session and data folder."""
    return _swept(spark.sparkContext.applicationId, sf_dir, fit, n, per_sample, beta)
