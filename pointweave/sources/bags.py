"""Recorded message bags (SQLite files of topics and messages) and their CDR messages: clouds and transforms.

A bag is found and opened by Spark's `binaryFile` reader and read by one task as an SQLite database in memory; several
bags are several tasks. Messages leave in batches of bounded size and are decoded where they are."""

from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The type names that topics carry, and the field type of a 32-bit float in a cloud message.
CLOUD_TYPE, TF_TYPE, FLOAT32 = "sensor_msgs/msg/PointCloud2", "tf2_msgs/msg/TFMessage", 7
MESSAGES = "path string, id long, topic string, type string, ts_ns long, data binary"


class Reader:
    """CDR, little or big endian as its head says; values are aligned to their size from after the head."""

    def __init__(self, data: bytes):
        if len(data) < 4 or data[0] != 0 or data[1] not in (0, 1):
            raise ValueError("not a CDR message")
        self.data, self.at, self.order = data, 4, "<" if data[1] else ">"

    def take(self, kind: str, size: int):
        self.at += -(self.at - 4) % size
        if self.at + size > len(self.data):
            raise ValueError("the message ends early")
        value = struct.unpack_from(self.order + kind, self.data, self.at)[0]
        self.at += size
        return value

    def u32(self) -> int:
        return self.take("I", 4)

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        n = self.u32()
        return self.raw(n)[:-1].decode() if n else ""


class Writer:
    def __init__(self):
        self.out = bytearray(b"\x00\x01\x00\x00")

    def put(self, kind: str, size: int, value) -> None:
        self.out += b"\0" * (-(len(self.out) - 4) % size) + struct.pack("<" + kind, value)

    def text(self, value: str) -> None:
        raw = value.encode() + b"\0"
        self.put("I", 4, len(raw))
        self.out += raw


def decode_cloud(data: bytes) -> dict:
    """frame_id, ts_ns, and float32 arrays x, y, z and, if the message has it, intensity."""
    r = Reader(data)
    sec, nanos, frame = r.take("i", 4), r.u32(), r.text()
    height, width, at = r.u32(), r.u32(), {}
    for _ in range(r.u32()):
        name, offset, kind, count = r.text().lower(), r.u32(), r.take("B", 1), r.u32()
        if name == "intensity" and (kind != FLOAT32 or count != 1):
            raise ValueError("intensity must be one 32-bit float")
        if name in ("x", "y", "z", "intensity") and kind == FLOAT32 and count == 1:
            at[name] = offset
    big, step, row = bool(r.take("B", 1)), r.u32(), r.u32()
    body = r.raw(r.u32())
    r.take("B", 1)
    head = {"frame_id": frame, "ts_ns": sec * 10**9 + nanos}
    kept = [n for n in ("x", "y", "z", "intensity") if n in at or n != "intensity"]
    if not height or not width:
        return head | {n: np.zeros(0, np.float32) for n in kept}
    if any(n not in at for n in "xyz"):
        raise ValueError("the cloud lacks x, y or z")
    if max(at.values()) + 4 > step or step * width > row or row * height > len(body):
        raise ValueError("the cloud's sizes don't agree")
    rows = np.frombuffer(body, np.uint8, row * height).reshape(height, row)[:, : step * width].reshape(-1, step)
    return head | {n: np.ascontiguousarray(rows[:, at[n] : at[n] + 4]).view(">f4" if big else "<f4")[:, 0].astype(np.float32) for n in kept}


def encode_cloud(frame_id: str, ts_ns: int, xyz: np.ndarray, intensity: np.ndarray | None = None) -> bytes:
    """A dense little-endian cloud message of one row."""
    names = ["x", "y", "z", *(["intensity"] if intensity is not None else [])]
    body = np.column_stack([xyz, *([intensity] if intensity is not None else [])]).astype("<f4")
    w = Writer()
    w.put("i", 4, ts_ns // 10**9)
    w.put("I", 4, ts_ns % 10**9)
    w.text(frame_id)
    for v in (1, len(body), len(names)):
        w.put("I", 4, v)
    for k, n in enumerate(names):
        w.text(n)
        w.put("I", 4, 4 * k)
        w.put("B", 1, FLOAT32)
        w.put("I", 4, 1)
    w.put("B", 1, 0)
    for v in (4 * len(names), 4 * len(names) * len(body), body.nbytes):
        w.put("I", 4, v)
    w.out += body.tobytes()
    w.put("B", 1, 1)
    return bytes(w.out)


def decode_transforms(data: bytes) -> list[tuple]:
    """(ts_ns, parent, child, tx, ty, tz, qx, qy, qz, qw) of each transform."""
    r = Reader(data)
    out = []
    for _ in range(r.u32()):
        sec, nanos, parent, child = r.take("i", 4), r.u32(), r.text(), r.text()
        out.append((sec * 10**9 + nanos, parent, child, *(r.take("d", 8) for _ in range(7))))
    return out


def encode_transforms(rows: list[tuple]) -> bytes:
    w = Writer()
    w.put("I", 4, len(rows))
    for ts, parent, child, *numbers in rows:
        w.put("i", 4, ts // 10**9)
        w.put("I", 4, ts % 10**9)
        w.text(parent)
        w.text(child)
        for v in numbers:
            w.put("d", 8, v)
    return bytes(w.out)


def messages(spark: SparkSession, path: str, topics: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """(path, id, topic, type, ts_ns, data) of the messages of all bags below path; topics and type are chosen inside
    the database, so that other payloads aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.db3").load(path)
    schema = pa.schema([("path", pa.string()), ("id", pa.int64()), ("topic", pa.string()), ("type", pa.string()), ("ts_ns", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                name, db = b.column(0)[k].as_py(), sqlite3.connect(":memory:")
                db.deserialize(b.column(1)[k].as_py())
                tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                if not {"topics", "messages"} <= tables:
                    raise ValueError(f"{name} is no bag")
                known = {i: (n, t) for i, n, t in db.execute("SELECT id, name, type FROM topics") if (topics is None or n in topics) and (kind is None or t == kind)}
                held = []
                for i, topic, ts, data in db.execute("SELECT id, topic_id, timestamp, data FROM messages WHERE topic_id IN (SELECT value FROM json_each(?)) ORDER BY timestamp, id", (str(list(known)),)):
                    held.append((name, i, *known[topic], ts, data))
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                db.close()

    return files.select("path", "content").mapInArrow(run, MESSAGES)


def topic_list(spark: SparkSession, path: str) -> DataFrame:
    """(topic, type, messages, largest, first_ns, last_ns) over all bags, topics without messages left out."""
    m = messages(spark, path)
    return m.groupBy("topic", "type").agg(F.count("*").alias("messages"), F.max(F.length("data")).alias("largest"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def clouds(spark: SparkSession, path: str, topics: list[str] | None = None, chunk: int = 16_384) -> DataFrame:
    """(path, topic, sequence, message_ts, frame_id, ts_ns, pid, x, y, z, intensity): the points of all cloud messages
    with their provenance; sequence is the message's id, pid the place in it; intensity is null where a message has none."""
    names = "path string, topic string, sequence long, message_ts long, frame_id string, ts_ns long, pid long, x float, y float, z float, intensity float"
    types = {"string": pa.string(), "long": pa.int64(), "float": pa.float32()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in names.split(", ")])

    def run(batches):
        for b in batches:
            for p, i, topic, _, ts, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                c = decode_cloud(data)
                for s in range(0, len(c["x"]), chunk):
                    e = slice(s, s + chunk)
                    n = len(c["x"][e])
                    own = [c[a][e] for a in "xyz"] + [c["intensity"][e] if "intensity" in c else pa.nulls(n, pa.float32())]
                    head = [[v] * n for v in (p, topic, i, ts, c["frame_id"], c["ts_ns"])]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v for v, f in zip([*head, np.arange(s, s + n), *own], schema)], schema=schema)

    return messages(spark, path, topics, CLOUD_TYPE).mapInArrow(run, names)


def transforms(spark: SparkSession, path: str, topic: str, most: int) -> DataFrame:
    """The transforms of a topic's first `most` messages by (time stamp, id), with the message's id and place in it."""
    first = messages(spark, path, [topic], TF_TYPE).orderBy("ts_ns", "id").limit(most)
    names = "sequence long, place long, ts_ns long, parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double"

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = [(i, k, *t) for i, data in zip(p.id, p.data) for k, t in enumerate(decode_transforms(bytes(data)))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])

    return first.select("id", "data").mapInPandas(run, names)
