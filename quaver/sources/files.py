"""Project archives and audio files: binary columns in, binary columns out."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a project archive.
MEMBERS = {"project": "project.json", "lyrics": "data/lyrics.json", "timing": "inner/timing.json"}
#: Audio extensions and their media types.
MEDIA = {"mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/aac", "wma": "audio/x-ms-wma"}


def media_type(path):
    """The media type of an audio path by its extension; null for others."""
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.get(F.array(kinds[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))]), 0)


def data_url(path, content):
    """A data URL of an audio file's bytes, in one line; null for other files."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def present(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, exists of named files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return spark.createDataFrame([(p, place(p).getFileSystem(conf).exists(place(p))) for p in paths], "path string, exists boolean")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pack_projects(projects: DataFrame) -> DataFrame:
    """song_id, content: an archive of each row's project, lyrics and timing (JSON strings)."""

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                whole = io.BytesIO()
                with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
                    for member, text in zip(MEMBERS.values(), row, strict=True):
                        if text is not None:
                            z.writestr(zipfile.ZipInfo(member), text)
                out.append(whole.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["song_id", "content"])

    return projects.select("song_id", *MEMBERS).mapInArrow(run, "song_id long, content binary")


def unpack_projects(archives: DataFrame) -> DataFrame:
    """song_id, project, lyrics, timing, error of archives (song_id, content)."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for whole in batch.column(1).to_pylist():
                found, error = [None] * 3, None
                try:
                    with zipfile.ZipFile(io.BytesIO(whole or b"")) as z:
                        have = set(z.namelist())
                        found = [z.read(m).decode() if m in have else None for m in MEMBERS.values()]
                        json.loads(found[0] or "{}")
                except (zipfile.BadZipFile, ValueError, RuntimeError) as x:
                    error = type(x).__name__
                for col, v in zip(cols, [*found, error], strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["song_id", *MEMBERS, "error"])

    return archives.select("song_id", "content").mapInArrow(run, "song_id long, project string, lyrics string, timing string, error string")


def wav_bytes(channels: list[list[float]], rate: int) -> bytes:
    """A 32-bit float WAV file of equally long channels."""
    import numpy as np

    data = np.stack([np.asarray(c, "<f4") for c in channels], axis=1).tobytes() if channels else b""
    n = max(1, len(channels))
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, n, rate, rate * n * 4, n * 4, 32)
    return head + b"data" + struct.pack("<I", len(data)) + data


def wav_header(whole: bytes | None) -> tuple[int, int, int, int] | None:
    """Channels, rate, bits and frames of a PCM or float WAV file, wherever its data chunk is."""
    if not whole or whole[:4] != b"RIFF" or whole[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(whole):
        name, size = whole[at : at + 4], struct.unpack("<I", whole[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(whole):
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", whole[at + 8 : at + 24])
            form = (channels, rate, bits) if kind in (1, 3) and channels and bits >= 8 else None
        if name == b"data":
            return (*form, size // (form[0] * form[2] // 8)) if form else None
        at += 8 + size + size % 2
    return None


def write_wav(signals: DataFrame, rate: int) -> DataFrame:
    """song_id, content: a WAV file of each row's samples: one channel, or an array of channels of one
    length, whose samples are interleaved."""
    import pyspark.sql.types as S

    many = isinstance(signals.schema["samples"].dataType.elementType, S.ArrayType)

    def run(batches):
        for batch in batches:
            out = [wav_bytes((x or [[]]) if many else [x or []], rate) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["song_id", "content"])

    return signals.select("song_id", "samples").mapInArrow(run, "song_id long, content binary")


def probe_wav(files: DataFrame) -> DataFrame:
    """song_id, channels, rate, bits, frames of files (song_id, content); nulls for what isn't WAV."""

    def run(batches):
        for batch in batches:
            rows = [wav_header(x) or (None,) * 4 for x in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["song_id", "channels", "rate", "bits", "frames"])

    return files.select("song_id", "content").mapInArrow(run, "song_id long, channels long, rate long, bits long, frames long")


def _decoded(whole: bytes | None) -> tuple[int, list]:
    """Frames and channels (numpy arrays of doubles within -1 and 1) of a WAV file; none for others."""
    import numpy as np

    form = wav_header(whole)
    if form is None:
        return 0, []
    channels, _, bits, _ = form
    at = 12
    kind = 1
    while whole[at : at + 4] != b"data":
        if whole[at : at + 4] == b"fmt ":
            kind = struct.unpack("<H", whole[at + 8 : at + 10])[0]
        size = struct.unpack("<I", whole[at + 4 : at + 8])[0]
        at += 8 + size + size % 2
    size = struct.unpack("<I", whole[at + 4 : at + 8])[0]
    width = bits // 8
    data = np.frombuffer(whole, np.uint8, min(size, len(whole) - at - 8) // (width * channels) * width * channels, at + 8)
    if kind == 3:
        x = data.view("<f4" if width == 4 else "<f8").astype(np.float64)
    elif width == 1:
        x = (data.astype(np.float64) - 128) / 128
    else:
        # The highest byte has the sign; all are taken as the top of 32 bits.
        wide = np.zeros((len(data) // width, 4), np.uint8)
        wide[:, 4 - min(width, 4) :] = data.reshape(-1, width)[:, -4:]
        x = wide.view("<i4")[:, 0] / 2.0**31
    x = x.reshape(-1, channels)
    return len(x), [x[:, c] for c in range(channels)]


def wav_blocks(files: DataFrame, size: int = 1 << 16) -> DataFrame:
    """song_id, channel, first, total, samples (array<double>) of WAV files (song_id, content): rows of blocks, as
    ``operators.blocks`` takes them, of each channel. Whole numbers of 8 to 32 bits are scaled to -1 .. 1. What isn't
    WAV gives no rows, a file without frames a block without samples."""

    def run(batches):
        for batch in batches:
            for song, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, channels = _decoded(whole.as_py())
                for c, x in enumerate(channels):
                    for first in range(0, max(n, 1), size):
                        yield pa.RecordBatch.from_pylist([{"song_id": song, "channel": c, "first": first, "total": n, "samples": x[first : first + size].tolist()}], schema=arrow)

    arrow = pa.schema([("song_id", pa.int64()), ("channel", pa.int32()), ("first", pa.int64()), ("total", pa.int64()), ("samples", pa.list_(pa.float64()))])
    return files.select("song_id", "content").mapInArrow(run, "song_id long, channel int, first long, total long, samples array<double>")
