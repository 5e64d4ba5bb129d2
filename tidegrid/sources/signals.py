"""Recordings: text files of integer samples, one row per sample, one column per channel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import Acquisition
from tidegrid.functions.names import parse_name, quarantine

REPORT = "n_samples long, duration_s double, n_wraparound_fixed long, dc_offset array<double>"
RECORDING = f"subject_id string, task string, source_name string, {REPORT}, data array<array<double>>, error string"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Every .txt file with its parsed name, its status (valid or quarantined) and the SHA-256 of its content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    # scans skip empty files; the listing that every read makes has them
    listed = spark.createDataFrame([(unquote(re.sub("^file:/+", "file:/", p)),) for p in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    files = files.select("path", "content").unionByName(empty)
    name = F.element_at(F.split("path", "/"), -1)
    parsed = parse_name(name)
    return files.select("path", name.alias("source_name"), *(c.alias(n) for n, c in parsed.items()), quarantine(name).alias("status"), F.sha2("content", 256).alias("sha256"), "content")


def parse_samples(content: bytes, cfg: Acquisition) -> np.ndarray:
    """(channels, samples) after the contract's checks; ValueError says what is wrong."""
    lines = [x.split() for x in content.split(b"\n")]
    lines = [x for x in lines if x]
    width = len(cfg.channels)
    if not lines or any(len(x) != width for x in lines):
        raise ValueError(f"expected {width} columns in every row")
    values = np.array(lines, dtype=float)
    if not np.isfinite(values).all():
        raise ValueError("values that are not finite")
    if not np.allclose(values, np.round(values)):
        raise ValueError("values that are not integers")
    if len(lines) / cfg.fs > cfg.max_seconds:
        raise ValueError("recording is too long")
    return np.ascontiguousarray(values.reshape(-1, width).T)


def read_recordings(spark: SparkSession, folder: str, cfg: Acquisition) -> DataFrame:
    """One row per valid file: its report and its samples by channel, or the error that keeps it out.

    A file is one row, and tasks take files; a broken file is a row with an error, never a failed job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = dict(subject_id=row.subject_id, task=row.task, source_name=row.source_name, n_samples=None, duration_s=None, n_wraparound_fixed=None, dc_offset=None, data=None, error=None)
                try:
                    if row.task not in cfg.tasks:
                        raise ValueError(f"task {row.task} is not expected")
                    data = parse_samples(row.content, cfg)
                    wrapped = data > 2 ** (cfg.container_bits - 1)
                    data = np.where(wrapped, data - 2.0**cfg.container_bits, data)
                    out |= dict(n_samples=data.shape[1], duration_s=data.shape[1] / cfg.fs, n_wraparound_fixed=int(wrapped.sum()), dc_offset=data.mean(axis=1), data=list(data))
                except ValueError as error:
                    out["error"] = str(error)[:200]
                yield pd.DataFrame([out])

    valid = discover(spark, folder).filter("status = 'valid'").select("subject_id", "task", "source_name", "content")
    return valid.mapInPandas(run, RECORDING)


def samples(recordings: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Long form of packed recordings: (subject_id, task, channel, i, v)."""
    by_channel = recordings.filter("error is null").select("subject_id", "task", F.posexplode("data").alias("c", "x"))
    names = F.array(*map(F.lit, channels))
    return by_channel.select("subject_id", "task", F.get(names, F.col("c")).alias("channel"), F.posexplode("x").alias("i", "v"))


def synthetic(fs: float, seconds: float, tone_hz: float = 10.0, settle_s: float = 120.0, seed: int = 0, channels: int = 3) -> np.ndarray:
    """A seeded test recording (channels, samples) of integers: each channel is a tone of its own phase over coloured noise.

    Both start louder and come down in a straight line until ``settle_s``, after which the level is steady.
    """
    draw = np.random.default_rng(seed)
    n = int(round(fs * seconds))
    seconds_in = np.arange(n) / fs
    level = 400.0 + 1200.0 * np.clip(1.0 - seconds_in / max(settle_s, 1e-9), 0.0, 1.0)
    phases = draw.uniform(0, 0.6, size=(channels, 1))
    tone = np.cos(2 * np.pi * tone_hz * seconds_in + phases)
    white = draw.normal(size=(channels, n + 3))
    noise = (white[:, 3:] + white[:, 2:-1] + white[:, 1:-2] + white[:, :-3]) / 4
    return np.rint(level * (tone + noise))
