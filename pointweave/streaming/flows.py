"""Structured Streaming: stateless stages, windowed and voxel aggregates, a tracker and a background model with state."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.grids import voxel_keys


def source(spark: SparkSession, path: str, schema, files: int = 64, form: str = "parquet") -> DataFrame:
    """A stream of the files below path; `files` bounds a micro-batch (back-pressure)."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def drain(df: DataFrame, to: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> dict:
    """Runs what is there to a sink and returns a receipt: batches, rows in, rows out if the sink tells (else -1).
    In complete mode each batch replaces the table."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda b, _: b.write.mode("overwrite").format(form).save(to)).start()
    else:
        q = w.format(form).start(to)
    q.awaitTermination()
    seen = [json.loads(p.json) if not isinstance(p, dict) else p for p in q.recentProgress]
    return {"batches": len(seen), "rows_in": sum(p["numInputRows"] for p in seen), "rows_out": seen[-1]["sink"].get("numOutputRows", -1) if seen else 0}


def voxels(df: DataFrame, leaf: float) -> DataFrame:
    """Centroids of finite points over cells from the origin; for complete or update mode."""
    finite = df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in "xyz"))
    return voxel_keys(finite, leaf, (0, 0, 0)).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def windowed(df: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Count and mean of each key and window; rows later than the watermark go, closed windows leave the state."""
    w = df.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), key, "n", "mean")


TRACK = "stream string, frame long, id long, class_id long, x0 double, y0 double, x1 double, y1 double, score double, age long, hits long, missed long, state string"
STATE = "next long, tracks string"


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def advance(tracks: list[dict], boxes: list[tuple], new_id: int, least_iou: float, confirm: int, most_missed: int):
    """One frame: tracks by id take their best unused box of their class (equal overlaps: the first); the other boxes
    begin tracks; tracks missed more than most_missed frames end. boxes: (class_id, score, box). (tracks, next id)"""
    free = dict(enumerate(boxes))
    out = []
    for t in tracks:
        t = t | {"age": t["age"] + 1, "missed": t["missed"] + 1}
        near = [(-_iou(t["box"], b), k) for k, (c, _, b) in free.items() if c == t["class_id"]]
        if near and -min(near)[0] >= least_iou:
            _, t["score"], t["box"] = free.pop(min(near)[1])
            t |= {"hits": t["hits"] + 1, "missed": 0}
        out.append(t)
    for c, s, b in free.values():
        out.append({"id": new_id, "class_id": c, "score": s, "box": b, "age": 1, "hits": 1, "missed": 0})
        new_id += 1
    for t in out:  # once confirmed, always
        t["state"] = "confirmed" if t["hits"] >= confirm else "tentative"
    return [t for t in out if t["missed"] <= most_missed], new_id


def track(df: DataFrame, least_iou: float = 0.3, confirm: int = 3, most_missed: int = 5) -> DataFrame:
    """Tracks after each frame of (stream, frame, det, class_id, score, x0, y0, x1, y1). State is kept for each stream;
    frames must arrive in order (a stream's batch is sorted, an older frame than the last raises). A frame without
    detections is one row with a null det."""

    def step(key, frames, state):
        new_id, tracks, last = 1, [], -(1 << 62)  # ids begin at 1
        if state.exists:
            new_id, held = state.get
            held = json.loads(held)
            tracks, last = held["tracks"], held["last"]
        rows = pd.concat(list(frames)).sort_values(["frame", "det"], na_position="last")
        out = []
        for frame, part in rows.groupby("frame"):
            if frame <= last:
                raise ValueError(f"frame {frame} of {key[0]} after {last}")
            last = int(frame)
            part = part[part.det.notna()]
            boxes = [(int(r.class_id), float(r.score), [float(r.x0), float(r.y0), float(r.x1), float(r.y1)]) for r in part.itertuples()]
            tracks, new_id = advance(tracks, boxes, new_id, least_iou, confirm, most_missed)
            out += [(key[0], last, t["id"], t["class_id"], *t["box"], t["score"], t["age"], t["hits"], t["missed"], t["state"]) for t in tracks]
        state.update((new_id, json.dumps({"tracks": tracks, "last": last})))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACK.split(", ")])

    return df.groupBy("stream").applyInPandasWithState(step, TRACK, STATE, "append", GroupStateTimeout.NoTimeout)


TILE = 32


def background_step(values: np.ndarray, mean: np.ndarray, var: np.ndarray, rate: float, sigma: float, initial: float):
    """One frame's values against the model of the same pixels (NaN mean: not seen yet): foreground, mean, variance.
    The first value sets the mean and is background; foreground is learned at a tenth of the rate."""
    fresh = np.isnan(mean)
    delta = np.where(fresh, 0.0, values - mean)
    fore = np.abs(delta) > sigma * np.sqrt(np.maximum(var, 1.0))
    alpha = np.where(fore, rate * 0.1, rate)
    new = np.maximum((1 - alpha) * var + alpha * delta * delta, 1.0)
    return fore & ~fresh, np.where(fresh, values, mean + alpha * delta), np.where(fresh, initial, new)


def background(df: DataFrame, rate: float = 0.02, sigma: float = 3.0, initial: float = 225.0) -> DataFrame:
    """(y, x, frame, foreground) of (y, x, frame, v): a running mean and variance of each pixel; foreground if a value
    lies over sigma deviations from the mean. A tile of pixels is one state, worked on as arrays frame by frame; frames
    of a batch are sorted, a pixel occurs once in a frame."""

    def step(key, parts, state):
        mean, var = (np.frombuffer(b, float).copy() for b in state.get) if state.exists else (np.full(TILE * TILE, np.nan), np.full(TILE * TILE, initial))
        rows = pd.concat(list(parts)).sort_values("frame", kind="stable")
        at = (rows.y.to_numpy() % TILE * TILE + rows.x.to_numpy() % TILE).astype(int)
        v, frame, fore = rows.v.to_numpy(float), rows.frame.to_numpy(), np.zeros(len(rows), bool)
        begin = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
        for a, b in zip(begin, np.append(begin[1:], len(rows))):
            k = at[a:b]
            fore[a:b], mean[k], var[k] = background_step(v[a:b], mean[k], var[k], rate, sigma, initial)
        state.update((mean.tobytes(), var.tobytes()))
        yield pd.DataFrame({"y": rows.y.to_numpy(), "x": rows.x.to_numpy(), "frame": frame, "foreground": fore})

    tiled = df.withColumns({"_ty": F.floor(F.col("y") / TILE), "_tx": F.floor(F.col("x") / TILE)})
    return tiled.groupBy("_ty", "_tx").applyInPandasWithState(step, "y long, x long, frame long, foreground boolean", "mean binary, var binary", "append", GroupStateTimeout.NoTimeout)


def continuity(df: DataFrame) -> DataFrame:
    """Rows (source, sequence, point_offset, n) of a table of chunks that don't follow their predecessor."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("sequence", "point_offset")
    want = F.lag(F.col("point_offset") + F.col("n")).over(w)
    return df.withColumns({"want": F.coalesce(want, F.lit(0)), "before": F.lag("sequence").over(w)}).where((F.col("point_offset") != F.col("want")) | (F.col("sequence") != F.col("before") + 1)).drop("want", "before")
