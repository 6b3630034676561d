"""Robots exclusion: first rule that matches, in file order, of the first group that names the agent."""

from __future__ import annotations

import functools
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced


@functools.lru_cache(maxsize=1024)
def parsed(body: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return parser


def can_fetch(agent: str):
    """(policy body, url) -> allowed; true without a policy. Each distinct policy of a batch is parsed once."""

    @F.arrow_udf(T.BooleanType())
    @sliced
    def run(body: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([b is None or u is None or parsed(b).can_fetch(agent, u) for b, u in zip(body.to_pylist(), url.to_pylist())], pa.bool_())

    return run
