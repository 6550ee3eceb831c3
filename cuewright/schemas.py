"""Schemas of the relations that a container file gives."""

SEGMENTS = "path string, title string, muxing_app string, writing_app string, duration double, timecode_scale bigint, date_utc_ns bigint, segment_uid binary, prev_uid binary, next_uid binary, duration_ms bigint"
TRACKS = "path string, track_index int, track_id bigint, type string, codec string, language string, name string, is_default boolean, is_forced boolean, codec_private binary, header_stripping binary, width bigint, height bigint, channels smallint, sample_rate double, bit_depth smallint, track_uid decimal(20,0)"
CHAPTERS = "path string, node int, parent_node int, depth int, ordinal int, id decimal(20,0), title string, start_ms bigint, end_ms bigint, segment_uid binary"
ATTACHMENTS = "path string, att_index int, id decimal(20,0), name string, mime_type string, size bigint, data binary"
TAGS = "path string, tag_index int, target_type string, target_id decimal(20,0)"
SIMPLE_TAGS = "path string, tag_index int, node int, parent_node int, depth int, name string, value string, data binary, language string"
CUES = "path string, cue_index int, time_raw bigint, time_ms bigint, track bigint, cluster_pos bigint"
BLOCKS = "path string, block_seq bigint, lace_index int, cluster_pos bigint, cluster_ts_raw bigint, track_number bigint, timecode_ms bigint, keyframe boolean, data binary, data_len bigint"
ELEMENTS = "path string, offset bigint, depth int, id bigint, name string, header_len int, size bigint"
ERRORS = "path string, table string, n_blocks bigint, message string"
FILES = "path string, length bigint"
SEEKS = "path string, seek_index int, name string, position bigint, is_there boolean"

TABLES = {"segments": SEGMENTS, "tracks": TRACKS, "chapters": CHAPTERS, "attachments": ATTACHMENTS, "tags": TAGS, "simple_tags": SIMPLE_TAGS, "cues": CUES, "blocks": BLOCKS, "elements": ELEMENTS, "errors": ERRORS, "files": FILES, "seeks": SEEKS}
