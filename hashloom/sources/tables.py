"""Other inputs and outputs: ground truth, margin curves, run logs, manifests, index payloads."""

from __future__ import annotations

import io
import json
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_TRUTH = "struct<ground_truth_indices:array<array<bigint>>,ground_truth_distances:array<array<double>>>"


def read_truth_json(spark: SparkSession, path: str, metric: str | None = None, n_vectors: int | None = None) -> DataFrame:
    """qid, rank, vec_id, dist (null without distances) from a JSON of lists, flat or below a metric's key and a key of the number of vectors."""
    whole = spark.read.text(path, wholetext=True)
    at = "$" + (f"['{metric}']" if metric else "") + (f"['{n_vectors}']" if n_vectors is not None else "")
    t = whole.select(F.from_json(F.get_json_object("value", at) if at != "$" else F.col("value"), _TRUTH).alias("t")).select("t.*")
    if t.where("ground_truth_indices is null").limit(1).count():
        raise ValueError(f"{path}: no ground_truth_indices at {at}")
    q = t.select(F.posexplode("ground_truth_indices").alias("qid", "ids"), "ground_truth_distances")
    q = q.select("qid", "ids", F.get("ground_truth_distances", F.col("qid")).alias("ds"))
    e = q.select("qid", "ds", F.posexplode("ids").alias("r", "vec_id"))
    return e.select(F.col("qid").cast("bigint").alias("qid"), (F.col("r") + 1).alias("rank"), "vec_id", F.get("ds", F.col("r")).alias("dist"))


def truth_from_arrays(ids: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """qid, rank, vec_id, dist from matrices read as (vec_id: the query, embedding: the row), as vector files give them."""
    e = ids.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("r", "v"))
    e = e.select("qid", "r", F.col("v").cast("bigint").alias("vec_id"))
    if distances is None:
        return e.select("qid", (F.col("r") + 1).alias("rank"), "vec_id", F.lit(None).cast("double").alias("dist"))
    d = distances.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("r", "dist"))
    return e.join(d, ["qid", "r"]).select("qid", (F.col("r") + 1).alias("rank"), "vec_id", F.col("dist").cast("double").alias("dist"))


CURVE_COLUMNS = ("dbest2_knot", "n_samples", "window_halfwidth", "q95_raw", "q99_raw", "q95_use", "q99_use")


def read_margin_curve(spark: SparkSession, path: str) -> DataFrame:
    """The columns of CURVE_COLUMNS as doubles, by name in any order, sorted by knot; lines with # are comments. Raises without rows or a column."""
    df = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if missing := set(CURVE_COLUMNS) - set(df.columns):
        raise ValueError(f"{path}: no columns {sorted(missing)}")
    out = df.select(*(F.col(c).cast("double").alias(c) for c in CURVE_COLUMNS)).where("dbest2_knot is not null").orderBy("dbest2_knot")
    if out.isEmpty():
        raise ValueError(f"{path}: no rows")
    return out


def log_run(spark: SparkSession, path: str, stage: str, payload) -> None:
    """Append a stage's payload (a dataclass or plain values) to a run log."""
    body = json.dumps(asdict(payload) if is_dataclass(payload) else payload, default=str)
    spark.sql("select :s as stage, :p as payload, current_timestamp() as ts", args={"s": stage, "p": body}).write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str) -> DataFrame:
    """stage, payload: the last one of each stage."""
    return spark.read.parquet(path).groupBy("stage").agg(F.max_by("payload", "ts").alias("payload"))


def config_from(spark: SparkSession, path: str, stage: str, kind: type, **overrides):
    """A config of a dataclass from a logged stage; keys that the class doesn't have are ignored, overrides win."""
    row = last_runs(spark, path).where(F.col("stage") == stage).first()
    known = kind.__dataclass_fields__.keys()
    stored = {k: v for k, v in json.loads(row["payload"]).items() if k in known and not is_dataclass(kind.__dataclass_fields__[k].type) and not isinstance(v, dict)} if row else {}
    return kind(**(stored | overrides))


def _first(found, key: str):
    """The value of the first key of this name, in the order of the text, however deep."""
    if isinstance(found, dict):
        for k, v in found.items():
            if k == key:
                return v
            if (got := _first(v, key)) is not None:
                return got
    elif isinstance(found, list):
        for v in found:
            if (got := _first(v, key)) is not None:
                return got
    return None


def config_file(spark: SparkSession, path: str, kind: type, overrides: Sequence[str] = ()):
    """A config of a dataclass from a JSON file: for each of its fields the first key of that name at any depth; `name=value` overrides come
    after, the last one wins. Values take the type of the field's default. Raises ValueError for an override that names no field."""
    return config_text(spark.read.text(path, wholetext=True).first()["value"], kind, overrides)


def config_text(text: str, kind: type, overrides: Sequence[str] = ()):
    """`config_file` from the JSON itself."""
    whole = json.loads(text)
    fields = kind.__dataclass_fields__
    got = {k: v for k in fields if (v := _first(whole, k)) is not None and not isinstance(v, (dict, list))}
    for each in overrides:
        name, _, value = each.partition("=")
        if name not in fields:
            raise ValueError(f"no setting {name}")
        got[name] = value
    as_type = {"int": int, "float": float, "str": str, "bool": lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes", "on")}
    return kind(**{k: as_type.get(str(fields[k].type), lambda v: v)(v) for k, v in got.items()})


def chosen_weights(training: dict, selector: str | None = None) -> str:
    """Path of the weights in a training result: by selector (stable_best, or topk:N from 1), else the stable best, the best model, or the
    one path of older results."""
    first = (training.get("results") or [{}])[0]
    best = [m.get("path") for m in first.get("best_models") or []]
    if selector:
        if selector == "stable_best" and first.get("stable_best_path"):
            return first["stable_best_path"]
        if selector.startswith("topk:") and 1 <= int(selector[5:]) <= len(best):
            return best[int(selector[5:]) - 1]
        raise ValueError(f"no weights for {selector}")
    for path in (first.get("stable_best_path"), *best[:1], first.get("weights_path")):
        if path:
            return path
    raise KeyError("no weights in the training result")


def index_config(training: dict, vector_dim: int, selector: str | None = None, keep_results: bool = True) -> dict:
    """What an index is built from, out of a training result: weights, dimensions, thresholds (the mean encoding until `with_thresholds`)."""
    out = {k: training.get(k) for k in ("config", "results", "timestamp")} if keep_results else {}
    build = {
        "model_path": chosen_weights(training, selector),
        "vector_dim": vector_dim,
        "hidden_dim": training["config"]["encoding_dim"],
        "margin_position": (training.get("results") or [{}])[0].get("mean_encoded"),
        "batch_size": training["config"]["training"]["batch_size"],
    }
    return out | {"build_index": build}


def with_thresholds(config: dict, thr: Sequence[float], digits: int | None = None, model_path: str | None = None, selector: str | None = None, score_max: int | None = None, stats: dict | None = None) -> dict:
    """The config with thresholds in place of the old ones, and how its model was selected; raises KeyError without a section build_index."""
    if not isinstance(config.get("build_index"), dict):
        raise KeyError("build_index")
    plain = None if stats is None else {k: v if v is None or isinstance(v, (int, float, str, bool)) else str(v) for k, v in stats.items()}
    new = {"margin_position": [float(t) if digits is None else round(float(t), digits) for t in thr], "model_path": model_path, "model_selector": selector, "model_select_score_max": score_max, "model_select_stats": plain}
    return config | {"build_index": config["build_index"] | {k: v for k, v in new.items() if v is not None}}


def search_configs(experiment: dict, kind: type, sweep: dict[str, Sequence] | None = None) -> list:
    """Search configs from an experiment: its settings wherever they stand, the bits from its thresholds, and one config for each combination of the
    swept values (the last field varies fastest)."""
    fields = kind.__dataclass_fields__
    base = {k: v for k in fields if (v := _first(experiment, k)) is not None and not isinstance(v, (dict, list))}
    if "bits" in fields and "bits" not in base and (thr := _first(experiment, "margin_position")):
        base["bits"] = len(thr)
    names = list(sweep or {})
    return [kind(**(base | dict(zip(names, values)))) for values in product(*(sweep[n] for n in names))] if names else [kind(**base)]


def truth_from_npz(spark: SparkSession, path: str, ids: str = "indices", distances: str = "distances") -> DataFrame:
    """qid, rank, vec_id, dist from an .npz of two matrices (distances may be missing). The file is read by Spark, its queries are few."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as z:
        found, far = z[ids], z[distances] if distances in z.files else None
    rows = [(q, found[q].tolist(), None if far is None else far[q].astype(float).tolist()) for q in range(len(found))]
    frame = spark.createDataFrame(rows, "qid bigint, ids array<bigint>, ds array<double>").select("qid", "ds", F.posexplode("ids").alias("r", "vec_id"))
    return frame.select("qid", (F.col("r") + 1).alias("rank"), "vec_id", F.get("ds", F.col("r")).alias("dist"))


def manifest(index_path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """artifact, path, schema, n of an index's tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("artifact"), F.lit(f"{index_path}/{name}").alias("path"), F.lit(df.schema.simpleString()).alias("schema"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def payload(members: DataFrame, vectors: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Index payload: each row's vector at its place in bucket (or bucket and cluster) order, numbered within its list."""
    w = W.partitionBy(*by).orderBy("vec_id")
    return members.select(*by, "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").withColumn("pos", F.row_number().over(w) - 1)
