"""WAV files of every width, read back in blocks."""

import struct

import numpy as np
import pytest

from quaver.sources import files


def pcm(values, bits, channels, kind=1, extra=b""):
    """A WAV file of interleaved frames (rows of values), with a chunk before its data."""
    flat = np.asarray(values).ravel()
    if kind == 3:
        data = flat.astype("<f4" if bits == 32 else "<f8").tobytes()
    elif bits == 8:
        data = (flat + 128).astype(np.uint8).tobytes()
    else:
        data = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in flat)
    head = struct.pack("<HHIIHH", kind, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + head + (b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2) if extra else b"") + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_whole_numbers(bits, channels):
    top = 1 << bits - 1
    values = np.array([[(-top, top - 1, 0, 1, -1, top // 2)[(i + c) % 6] for c in range(channels)] for i in range(7)])
    n, found = files._decoded(pcm(values, bits, channels, extra=b"odd"))
    assert n == 7 and len(found) == channels
    for c in range(channels):
        assert np.allclose(found[c], values[:, c] / top, atol=0)


@pytest.mark.parametrize("bits", [32, 64])
def test_floats(bits):
    n, (x,) = files._decoded(pcm([[0.5], [-0.25], [1e-3]], bits, 1, 3))
    assert n == 3 and np.allclose(x, [0.5, -0.25, 1e-3])


def test_blocks(spark):
    rows = [(1, bytearray(pcm([[i, -i] for i in range(10)], 16, 2))), (2, bytearray(b"no sound")), (3, None), (4, bytearray(pcm(np.zeros((0, 1)), 16, 1)))]
    got = files.wav_blocks(spark.createDataFrame(rows, "song_id long, content binary"), 4).collect()
    assert [(r.song_id, r.channel, r.first, r.total, len(r.samples)) for r in got] == [(1, 0, 0, 10, 4), (1, 0, 4, 10, 4), (1, 0, 8, 10, 2), (1, 1, 0, 10, 4), (1, 1, 4, 10, 4), (1, 1, 8, 10, 2), (4, 0, 0, 0, 0)]
    assert got[4].samples == [-4 / 2**15, -5 / 2**15, -6 / 2**15, -7 / 2**15]
