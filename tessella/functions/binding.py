"""Values that are computed once: inside one expression, or for several branches of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; Catalyst cannot copy a lambda variable into its uses."""
    return F.transform(F.array(value), body)[0]


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the checkpoint folder that the session names; branches read it from there.

    A lost executor loses nothing, and the files go when nothing refers to them any more and the session cleans
    checkpoints. Only a local session gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoints-"))
    return df.checkpoint()
