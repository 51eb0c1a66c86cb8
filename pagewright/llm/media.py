"""Media columns: FLAC bytes to PCM blocks that can be sought by sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import flac

_BLOCK = [("block", pa.int32()), ("frame_offset", pa.int64()), ("sample_offset", pa.int64()), ("samples", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("pcm", pa.binary()), ("status", pa.string()), ("md5_ok", pa.bool_())]
#: Rows and bytes of PCM that are sent on together.
_ROWS, _BYTES = 4096, 4 << 20


def decode(media: DataFrame, id_column: str = "media_id", content: str = "content") -> DataFrame:
    """media_id and, a row a FLAC frame: ``block``, ``frame_offset`` (byte), ``sample_offset``, ``samples``,
    ``sample_rate``, ``channels``, ``bits``, ``pcm`` (interleaved, little-endian), ``status``, ``md5_ok``.

    To seek to a sample, take the block of the greatest sample_offset not beyond it. Both checksums of each frame
    are verified. A frame that fails has no pcm and a ``status`` that says why, and decoding goes on at the next
    sound header; a stream of sound frames that ends before the samples it tells of, or after, has a row more whose
    status says so; ``md5_ok`` is set on the last block of a stream that decoded whole and carries a sum. Null, empty
    and other bytes give one row with a status and nothing else. A stream of any length is read whole, a block at a
    time. Repeated rows and null ids are decoded like others; other columns are not read. An empty df gives an
    empty result.
    """
    kind = media.schema[id_column].dataType
    schema = pa.schema([("media_id", to_arrow_type(kind)), *_BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, size = [], [], 0

            def sent():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())).cast(schema.field(0).type), *(pa.array([r[n] for r in rows], t) for n, t in _BLOCK)], schema=schema)

            for i, row in flac.blocks_of((i, x.as_py()) for i, x in enumerate(batch.column(1))):
                rows.append(row)
                at.append(i)
                size += len(row["pcm"] or b"")
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield sent()
                    rows, at, size = [], [], 0
            if rows:
                yield sent()

    return media.select(F.col(id_column).alias("media_id"), content).mapInArrow(run, f"media_id {kind.simpleString()}, block int, frame_offset long, sample_offset long, samples int, sample_rate int, channels int, bits int, pcm binary, status string, md5_ok boolean")


#: Samples that a few of a vector's values make, the values, and the pitches that they are the strengths of.
WAVE, VALUES, PITCHES = 16, 8, (0.05, 0.11, 0.23, 0.41)


def waves(vectors: np.ndarray) -> np.ndarray:
    """(vector, channel, sample) 16-bit integers: every ``VALUES`` values of a vector are the strengths of as many
    sines and cosines over ``WAVE`` samples. Values beyond [-1, 1] are clipped; the second channel is a softer first."""
    v = np.round(np.clip(np.nan_to_num(vectors), -1, 1), 6)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % VALUES))).reshape(len(v), -1, VALUES)
    t = np.arange(WAVE)
    sines = np.array([f(p * t) for p in PITCHES for f in (np.sin, np.cos)])
    x = (v @ sines).reshape(len(v), -1) * (32767 / VALUES)
    return np.round(np.stack([x, 0.8 * x], axis=1)).astype(np.int64)


def from_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", lpc: int = 8) -> DataFrame:
    """media_id, content: each vector, as ``waves`` make it sound, in FLAC of two channels, in blocks of four waves.

    The tables hold no media, so this makes them. Half of the vectors, by the parity of their first value in
    millionths, have linear predictors of order ``lpc`` throughout, the rest the shortest. A null or empty vector gives
    null content."""

    @F.arrow_udf("binary")
    def encoded(v: pa.Array) -> pa.Array:
        made = [x.as_py() for x in v]
        return pa.array([flac.encode(waves(np.array([x], float))[0], block=4 * WAVE, lpc=lpc, linear=int((x[0] or 0) * 1e6) % 2 == 0) if x else None for x in made], pa.binary())

    return vectors.select(F.col(id_column).alias("media_id"), encoded(F.col(vector)).alias("content"))
