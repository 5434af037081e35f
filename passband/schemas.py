"""Explicit schemas of the tables that cross a file or stream boundary."""

from __future__ import annotations

CHUNK = (
    "capture_id bigint, epoch int, chunk_no bigint, offset bigint, received timestamp, bytes binary"
)
MESSAGE = "msg_id bigint, received timestamp, bytes binary"
PACKET = (
    "capture_id bigint, epoch int, pkt_no bigint, received timestamp, apid int, seq_count int, pkt_len int"
)
FRAME = (
    "capture_id bigint, epoch int, frame_no bigint, received timestamp, vcid int, vc_count int, "
    "sync_flag int, fhp int, data binary"
)
SAMPLE = "pkt_no bigint, ordinal int, parameter string, received timestamp, raw double, eng double"

#: Columns of the exports, in file order.
SAMPLE_EXPORT = ("time", "received", "apid", "sequence", "parameter", "raw", "eng")
SNAPSHOT_EXPORT = ("parameter", "time", "raw", "eng", "unit", "updates", "limit")
HISTORY_EXPORT = ("parameter", "time", "value")

WATCH_LIST = (
    "version int, watched array<string>, "
    "plots array<struct<title:string,parameters:array<string>,height:double,autoscale:boolean,"
    "y_range:array<double>>>, history_depth int, theme string, show_raw boolean, "
    "tree_width double, events_height double"
)
