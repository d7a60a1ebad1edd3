"""Names of the codes in streams, as small tables to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of the standards for transport streams and subtitling. A range is (first, last).
TABLES: dict[str, list[tuple[int | tuple[int, int], str]]] = {
    "segment_types": [
        (0x10, "page composition"), (0x11, "region composition"), (0x12, "CLUT definition"), (0x13, "object data"), (0x14, "display definition"), (0x15, "disparity signalling"), (0x80, "end of display set"), ((0x81, 0xEF), "private"), (0xFF, "stuffing"),
    ],
    "data_ids": [(0x20, "DVB subtitling"), (0x21, "DVB synchronous data stream"), (0x22, "DVB synchronised data stream")],
    "stream_types": [
        (0x00, "reserved"), (0x01, "MPEG-1 video"), (0x02, "MPEG-2 video"), (0x03, "MPEG-1 audio"), (0x04, "MPEG-2 audio"), (0x05, "private sections"), (0x06, "private data in PES packets"), (0x07, "MHEG"), (0x08, "DSM-CC"), (0x09, "H.222.1"),
        (0x0A, "13818-6 type A"), (0x0B, "13818-6 type B"), (0x0C, "13818-6 type C"), (0x0D, "13818-6 type D"), (0x0E, "auxiliary"), (0x0F, "AAC audio with ADTS"), (0x10, "MPEG-4 visual"), (0x11, "MPEG-4 audio with LATM"), (0x12, "14496-1 in PES packets"),
        (0x13, "14496-1 in sections"), (0x14, "synchronized download protocol"), (0x15, "metadata in PES packets"), (0x16, "metadata in sections"), (0x17, "metadata in a data carousel"), (0x18, "metadata in an object carousel"),
        (0x19, "metadata in the synchronized download protocol"), (0x1A, "MPEG-2 IPMP"), (0x1B, "AVC video"), ((0x1C, 0x7E), "reserved"), (0x7F, "IPMP"), ((0x80, 0xFF), "user private"),
    ],
    "stream_ids": [
        (0xBC, "program stream map"), (0xBD, "private stream 1"), (0xBE, "padding stream"), (0xBF, "private stream 2"), ((0xC0, 0xDF), "audio stream"), ((0xE0, 0xEF), "video stream"), (0xF0, "ECM stream"), (0xF1, "EMM stream"), (0xF2, "DSM-CC stream"),
        (0xF3, "MHEG stream"), (0xF4, "H.222.1 type A"), (0xF5, "H.222.1 type B"), (0xF6, "H.222.1 type C"), (0xF7, "H.222.1 type D"), (0xF8, "H.222.1 type E"), (0xF9, "ancillary stream"), (0xFA, "14496-1 SL-packetized stream"),
        (0xFB, "14496-1 FlexMux stream"), (0xFC, "metadata stream"), (0xFD, "extended stream id"), (0xFE, "reserved data stream"), (0xFF, "program stream directory"),
    ],
}


def named(df: DataFrame, dictionary: str, code: str) -> DataFrame:
    """df with name of its code column; unknown codes have none. At most 256 rows are broadcast."""
    rows = [(c, name) for codes, name in TABLES[dictionary] for c in (range(codes[0], codes[1] + 1) if isinstance(codes, tuple) else (codes,))]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"{code} int, name string")), code, "left")
