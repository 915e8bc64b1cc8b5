"""Point-cloud and image files as DataFrames and back: PCD, PLY, LAS and PNM.

Files are found and opened by Spark's own `binaryFile` reader, so any store works; a file is one task, its rows leave
in Arrow batches of bounded size. Compressed LAS, E57 and COPC need codecs that are not installed: unknown formats raise."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH = 65_536
#: PCD and PLY type names, and LAS record fields (name, offset, type) shared by formats 0 to 5.
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4"}
PLY_TYPES = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "<u1", "uint8": "<u1", "char": "<i1", "int8": "<i1", "ushort": "<u2", "uint16": "<u2", "short": "<i2", "int16": "<i2", "uint": "<u4", "uint32": "<u4", "int": "<i4", "int32": "<i4"}
SQL_TYPES = {"f4": "float", "f8": "double", "u1": "short", "u2": "int", "u4": "long", "i1": "byte", "i2": "short", "i4": "int"}
ARROW = {"float": pa.float32(), "double": pa.float64(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64()}


def detect(path: str) -> str | None:
    """The format by its ending; `.copc.laz` before `.laz`; None if unknown."""
    p = path.lower()
    for end, name in ((".copc.laz", "copc"), (".pcd", "pcd"), (".ply", "ply"), (".las", "las"), (".laz", "laz"), (".e57", "e57"), (".pgm", "pnm"), (".ppm", "pnm"), (".pnm", "pnm")):
        if p.endswith(end):
            return name
    return None


def lzf(data: bytes, size: int) -> bytes:
    """Decompresses LZF: runs of literals and back references of up to 8 KiB."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        at = len(out) - ((c & 31) << 8 | data[i]) - 1
        i += 1
        if at < 0:
            raise ValueError("LZF reference before the start")
        for k in range(at, at + n + 2):
            out.append(out[k])
    if len(out) != size:
        raise ValueError("LZF size differs from the header")
    return bytes(out)


def _pcd(data: bytes):
    head = {}
    at = 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        line = data[at:end].decode("ascii").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, *rest = line.split()
            head[key] = rest
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    fields = []
    for name, size, kind, c in zip(head["FIELDS"], head["SIZE"], head["TYPE"], counts):
        if (kind, int(size)) not in PCD_TYPES:
            raise ValueError(f"PCD type {kind}{size}")
        fields += [(name if c == 1 else f"{name}_{k}", PCD_TYPES[kind, int(size)]) for k in range(c)]
    if head["DATA"] == ["ascii"]:
        return fields, _text(data[at:], fields, n)
    if head["DATA"] == ["binary"]:
        return fields, np.frombuffer(data, np.dtype(fields), n, at)
    packed, size = struct.unpack_from("<II", data, at)
    raw, out, off = lzf(data[at + 8 : at + 8 + packed], size), np.zeros(n, np.dtype(fields)), 0
    for name, t in fields:
        out[name] = np.frombuffer(raw, t, n, off)
        off += n * np.dtype(t).itemsize
    return fields, out


def _text(data: bytes, fields, n: int) -> np.ndarray:
    cells = data.split()[: n * len(fields)]
    if len(cells) < n * len(fields):
        raise ValueError("fewer values than the header says")
    out = np.zeros(n, np.dtype(fields))
    for k, (name, t) in enumerate(fields):
        out[name] = np.array(cells[k :: len(fields)]).astype(float if t[1] == "f" else np.int64)
    return out


def _ply(data: bytes):
    end = data.index(b"end_header")
    at = data.index(b"\n", end) + 1
    lines = [x.split() for x in data[:end].decode("ascii").splitlines()]
    form = next(x[1] for x in lines if x[:1] == ["format"])
    first = [x[1] for x in lines if x[:1] == ["element"]][:1]
    if first != ["vertex"] or form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY with {first} first in {form}")
    n, fields, on = 0, [], False
    for x in lines:
        if x[:1] == ["element"]:
            on = x[1] == "vertex"
            n = int(x[2]) if on else n
        elif on and x[:1] == ["property"]:
            fields.append((x[2], PLY_TYPES[x[1]]))
    return fields, _text(data[at:], fields, n) if form == "ascii" else np.frombuffer(data, np.dtype(fields), n, at)


def _las(data: bytes):
    if data[:4] != b"LASF":
        raise ValueError("no LAS signature")
    kind, size = data[104], struct.unpack_from("<H", data, 105)[0]
    start = struct.unpack_from("<I", data, 96)[0]
    n = struct.unpack_from("<I", data, 107)[0]
    if data[25] >= 4 and not n:
        n = struct.unpack_from("<Q", data, 247)[0]
    if kind & 0x80:
        raise ValueError("compressed LAS")
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    new = kind >= 6
    fields = [("X", 0, "<i4"), ("Y", 4, "<i4"), ("Z", 8, "<i4"), ("intensity", 12, "<u2"), ("classification", 16 if new else 15, "<u1")]
    if kind in (1, 3, 4, 5) or new:
        fields.append(("gps_time", 22 if new else 20, "<f8"))
    colour = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}.get(kind)
    if colour:
        fields += [(c, colour + 2 * k, "<u2") for k, c in enumerate(("red", "green", "blue"))]
    rec = np.frombuffer(data, np.dtype({"names": [f[0] for f in fields], "formats": [f[2] for f in fields], "offsets": [f[1] for f in fields], "itemsize": size}), n, start)
    plan = [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), *((a, t) for a, _, t in fields[3:])]
    out = np.zeros(n, np.dtype(plan))
    for k, (a, b) in enumerate(zip("xyz", "XYZ")):
        out[a] = rec[b] * scale[k] + offset[k]
    for a, _ in plan[3:]:
        out[a] = rec[a] & 31 if a == "classification" and not new else rec[a]
    return plan, out


def _pnm(data: bytes):
    """Pixels in row order: y, x, c, v."""
    head = re.match(rb"P([2356])\s+(?:#.*\s+)*(\d+)\s+(?:#.*\s+)*(\d+)\s+(?:#.*\s+)*(\d+)\s", data)
    if not head:
        raise ValueError("not a grey or colour PNM")
    kind, w, h, top = (int(g) for g in head.groups())
    c = 3 if kind in (3, 6) else 1
    n = w * h * c
    raw = np.array(data[head.end() :].split()[:n]).astype(int) if kind < 4 else np.frombuffer(data, ">u2" if top > 255 else "u1", n, head.end())
    fields = [("y", "<i4"), ("x", "<i4"), ("c", "<i4"), ("v", "<i4")]
    out = np.zeros(n, np.dtype(fields))
    k = np.arange(n)
    out["y"], out["x"], out["c"], out["v"] = k // (w * c), k // c % w, k % c, raw
    return fields, out


PARSE = {"pcd": _pcd, "ply": _ply, "las": _las, "pnm": _pnm}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, pid long from 0 in each file, the fields of the first file). A file that lacks one of these fields or
    ends early raises; fields that only later files have are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = files.orderBy("path").select("path", "content").first()
    if first is None:
        raise FileNotFoundError(path)
    kind = kind or detect(first.path)
    if kind not in PARSE:
        raise ValueError(f"no reader for {kind or first.path}")
    fields = [(n, SQL_TYPES[t[1:]]) for n, t in PARSE[kind](bytes(first.content))[0]]
    schema = pa.schema([("path", pa.string()), ("pid", pa.int64()), *((n, ARROW[t]) for n, t in fields)])

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                p, rows = b.column(0)[at].as_py(), PARSE[kind](b.column(1)[at].as_py())[1]
                for s in range(0, len(rows), BATCH):
                    part = rows[s : s + BATCH]
                    columns = [pa.array([p] * len(part)), pa.array(np.arange(s, s + len(part)))]
                    columns += [pa.array(np.ascontiguousarray(part[n]).astype(schema.field(n).type.to_pandas_dtype())) for n, _ in fields]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, pid long, " + ", ".join(f"`{n}` {t}" for n, t in fields))


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    """Long columns are written as doubles: the formats have no 64-bit integer."""
    back = {"float": "<f4", "double": "<f8", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<f8"}
    return [(f.name, back[f.dataType.simpleString()]) for f in df.schema if f.name not in ("path", "pid")]


def encode(rows: np.ndarray, fields, kind: str) -> bytes:
    """One binary PCD, binary PLY or LAS (format 0) file."""
    n = len(rows)
    if kind == "pcd":
        t = {"f": "F", "i": "I", "u": "U"}
        head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(f for f, _ in fields)}\nSIZE {' '.join(x[2] for _, x in fields)}\nTYPE {' '.join(t[x[1]] for _, x in fields)}\nCOUNT {' '.join('1' for _ in fields)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
        return head.encode() + rows.tobytes()
    if kind == "ply":
        name = {"<f4": "float", "<f8": "double", "<i1": "char", "<i2": "short", "<i4": "int"}
        return (f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property {name[x]} {f}\n" for f, x in fields) + "end_header\n").encode() + rows.tobytes()
    if kind != "las":
        raise ValueError(f"no writer for {kind}")
    xyz = np.stack([rows[a].astype(float) for a in "xyz"], 1) if n else np.zeros((1, 3))
    low, high, scale = xyz.min(0), xyz.max(0), 1e-3
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 0, 20, n)
    struct.pack_into("<I", head, 111, n)
    struct.pack_into("<6d", head, 131, *[scale] * 3, *low)
    struct.pack_into("<6d", head, 179, *(v for k in range(3) for v in (high[k], low[k])))
    out = np.zeros(n, np.dtype({"names": ["X", "Y", "Z", "i", "r", "k"], "formats": ["<i4"] * 3 + ["<u2", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, 15], "itemsize": 20}))
    for k, a in enumerate("XYZ"):
        out[a] = np.round((xyz[:n, k] - low[k]) / scale)
    for a, b in (("i", "intensity"), ("k", "classification")):
        if b in rows.dtype.names:
            out[a] = rows[b]
    return bytes(head) + out.tobytes()


def files(df: DataFrame, kind: str, rows: int = 1_000_000) -> DataFrame:
    """(content binary, n long): whole files of at most `rows` points, one after the other in each partition, as bytes.
    Sort or range-partition df first if the order matters."""
    fields = _columns(df)

    def run(batches):
        held, n = [], 0

        def pack(count):
            nonlocal held, n
            t = pa.Table.from_batches(held)
            part, rest = t.slice(0, count), t.slice(count)
            out = np.zeros(part.num_rows, np.dtype(fields))
            for name, _ in fields:
                out[name] = part.column(name).to_numpy()
            held, n = rest.to_batches(), rest.num_rows
            return pa.RecordBatch.from_arrays([pa.array([encode(out, fields, kind)], pa.large_binary()).cast(pa.binary()), pa.array([part.num_rows])], names=["content", "n"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            while n >= rows:
                yield pack(rows)
        if n:
            yield pack(n)

    return df.select(*(f for f, _ in fields)).mapInArrow(run, "content binary, n long")


def write(df: DataFrame, path: str, kind: str, rows: int = 1_000_000) -> int:
    """Writes files part-*.kind through the Hadoop file system of the path, by tasks; returns the points written. Names
    come from partition and order, so a task that runs again overwrites its own files."""
    from pyarrow import fs

    target, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    target.create_dir(base, recursive=True)
    tagged = files(df, kind, rows)

    def run(batches):
        from pyspark import TaskContext

        k, to = 0, fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0]
        for b in batches:
            for c, n in zip(b.column(0), b.column(1)):
                name = f"{base}/part-{TaskContext.get().partitionId():05d}-{k:04d}.{kind}"
                with to.open_output_stream(name) as f:
                    f.write(c.as_py())
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([n.as_py()])], names=["n"])

    return tagged.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def validate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict): ok, missing, extra, size or hash."""
    a = actual.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    verdict = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "hash").otherwise("ok")
    return expected.join(a, "path", "full").select("path", verdict.alias("verdict"))


def level_for_resolution(spacing: float, resolution: float):
    """The octree level whose spacing reaches the resolution."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.lit(spacing / resolution)))).cast("int")


def octree_levels(df: DataFrame, spacing: float, levels: int, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Adds `level`: the coarsest level in whose cells (edge spacing / 2^level) the point has the least pid. Levels 0 to
    L together are the cloud at spacing / 2^L; what is finer than the last level joins it. Write by level for pruning."""
    lows = df
    for k in range(levels - 1):
        edge = spacing / 2**k
        cell = [F.floor((F.col(a) - o) / edge).alias(f"_c{a}") for a, o in zip("xyz", origin)]
        first = df.groupBy(*cell).agg(F.min("pid").alias("pid")).select("pid").withColumn(f"_l{k}", F.lit(k))
        lows = lows.join(first, "pid", "left")
    out = lows.withColumn("level", F.coalesce(*(F.col(f"_l{k}") for k in range(levels - 1)), F.lit(levels - 1)))
    return out.drop(*(f"_l{k}" for k in range(levels - 1)))
