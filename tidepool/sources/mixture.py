"""Mixture loading (S2 chat mixtures, S3 plain corpora, S5 through a spec).

A spec names sources; each resolves through a registry of
``key -> loader(spark, root, options) -> DataFrame``.  A loader takes the
options that it knows out of the mapping; what it leaves there is an error,
as is a limit that is not a row count.  Every loader returns a DataFrame with
a ``split`` column (P13 makes a lone dataset ``train``).  Limits by split:

* of a source with several splits, each named split is cut to its first n
  rows (L2);
* of a source with one split, every requested split is cut from the same
  rows, so they overlap (L3).

Sources are merged split-wise by one ``unionByName`` (U2).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import normalise as nz
from tidepool.operators import split as sp
from tidepool.sources.readers import read_prepared
from tidepool.sources.spec import Source, SpecError, find_loader, parse

BASE_FOLDER = "TIDEPOOL_DATA"


def resolve(spark: SparkSession, name: str, base: str | None = None) -> str:
    """The place of a source: ``name`` under the base folder (an argument, or
    the folder named in ``TIDEPOOL_DATA``) if it is relative and there is
    such a path, else ``name`` itself.  Asks Spark's file system."""
    base = base or os.environ.get(BASE_FOLDER)
    if not base or name.startswith("/") or "://" in name:
        return name
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.toString() if files.exists(path) else name


def load_source(spark: SparkSession, source: Source, registry: dict, root: str, base: str | None = None) -> DataFrame | sp.Unsplit:
    """One source without its limits.  The loader gets the options that the
    spec gives it (``name``, a sub-config, like any other) and, as ``root``,
    the place of the source under the base folder if it lies there.  Options
    that it leaves raise."""
    options = dict(source.options)
    place = resolve(spark, source.name, base)
    df = find_loader(source.name, registry)(spark, root if place == source.name else place, options)
    for key, value in options.items():
        raise SpecError(f"source {source.name!r} takes no option {key!r} (value {value!r}; a limit is a whole number)")
    return df if isinstance(df, sp.Unsplit) else nz.ensure_split(df)


def _merged(spark, spec: str, key: str, load) -> DataFrame:
    """The sources of a spec.  Splits that are still to be cut are cut
    together, then all limits are applied together."""
    sources = parse(spec)
    if not sources:
        raise SpecError("the dataset spec names no source")
    for s in sources:
        if s.name is None:
            raise SpecError(f"a source without a name in {spec!r}")
    frames = [load(s) for s in sources]
    unsplit = [k for k, df in enumerate(frames) if isinstance(df, sp.Unsplit)]
    for k, df in zip(unsplit, sp.split_all([frames[k] for k in unsplit]) if unsplit else []):
        frames[k] = df
    limited = sp.limit_all([(df, s.limits) for df, s in zip(frames, sources)], key)
    return sp.merge_splits([df.withColumn("source", F.lit(s.name)) for df, s in zip(limited, sources)])


def load_mixture(spark: SparkSession, spec: str, registry: dict, root: str, key: str = "key", base: str | None = None) -> DataFrame:
    """Load, normalise, limit and merge the sources of ``spec``.  An
    option ``name`` is the loader's sub-config.  A loader may return rows
    still to be split (``Unsplit``)."""
    return _merged(spark, spec, key, lambda s: load_source(spark, s, registry, root, base))


def load_corpus(spark: SparkSession, spec: str, registry: dict, root: str, key: str = "key", base: str | None = None) -> DataFrame:
    """S3: plain-text sources; the same rules, and no shuffle on this path."""
    return load_mixture(spark, spec, registry, root, key, base)


def load_prepared(spark: SparkSession, spec: str, base: str | None = None, key: str = "key") -> DataFrame:
    """S5 through a spec: each source is the folder of a prepared dataset,
    read without normalisers; ``name`` picks a config, limits apply."""
    def load(s: Source) -> DataFrame:
        options = dict(s.options)
        df = read_prepared(spark, resolve(spark, s.name, base))
        config = options.pop("name", None)
        if config is not None:
            if "config" not in df.columns:
                raise SpecError(f"{s.name!r} has no configs")
            df = df.where(F.col("config") == config)
        for option in options:
            raise SpecError(f"prepared source {s.name!r} takes no option {option!r}")
        return nz.ensure_split(df)

    return _merged(spark, spec, key, load)
