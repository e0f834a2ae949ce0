"""Fitted artifacts shared by the jobs of one session.

The reference trains in one process, saves the vectorizer and the model, and
scores in others that load them.  Here a fit is written once to the shared
checkpoint folder -- a parquet table for the TF-IDF model, MLlib persistence
for learners -- and later jobs of the same session read it back instead of
refitting.  Keys include every fit parameter and the version of the input
tables (their files with sizes and modification times), so a changed input is
fitted anew; nothing survives the session.
"""

from __future__ import annotations

import hashlib
import json
import threading

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import scratch_path

_LOCK = threading.Lock()
_LOCKS: dict[tuple, threading.Lock] = {}
_STORE: dict[tuple, tuple[str, str]] = {}


#: Tables that fits read.
INPUTS = ("documents", "labels", "embeddings")


def input_version(spark: SparkSession, sf_dir: str) -> str:
    """Paths, sizes and times of the input tables' files (a listing; no job runs)."""
    jvm = spark._jvm
    found = []
    for name in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            for f in fs.listStatus(path):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def _key(spark: SparkSession, name: str, sf_dir: str, params: dict) -> tuple:
    return (spark.sparkContext.applicationId, name, input_version(spark, sf_dir), json.dumps(params, sort_keys=True))


def _held(k: tuple) -> threading.Lock:
    """One lock per artifact: of threads that ask for the same one, the first fits and the others wait."""
    with _LOCK:
        return _LOCKS.setdefault(k, threading.Lock())


def table(spark: SparkSession, name: str, sf_dir: str, params: dict, fit) -> DataFrame:
    """A fitted table (``fit() -> DataFrame``), written once as parquet."""
    k = _key(spark, name, sf_dir, params)
    with _held(k):
        if k not in _STORE:
            path = scratch_path(spark, f"artifact-{name}")
            fit().write.mode("overwrite").parquet(path)
            _STORE[k] = ("table", path)
    return spark.read.parquet(_STORE[k][1])


def model(spark: SparkSession, name: str, sf_dir: str, params: dict, fit, loader):
    """A fitted MLlib model (``fit() -> model``), saved once, loaded by ``loader(path)``."""
    k = _key(spark, name, sf_dir, params)
    with _held(k):
        if k not in _STORE:
            m = fit()
            path = scratch_path(spark, f"artifact-{name}")
            m.write().overwrite().save(path)
            _STORE[k] = ("model", path)
            return m
    return loader(_STORE[k][1])
