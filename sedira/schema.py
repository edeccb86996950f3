"""Schemas of the relations that storage data is read as. Unsigned 64-bit values are DECIMAL(20,0)."""

from __future__ import annotations

TIME = "struct<kind:string,ticks:decimal(20,0),nanos:int,ts:timestamp>"
LAYERS = "array<struct<vfs_type:string,path:string>>"
BLOB_CHUNK = "path string, chunk_no bigint, `offset` bigint, bytes binary"
HEAD_TAIL = "path string, length bigint, content binary, head_length int"
OS_ENTRY = f"path string, name string, file_type string, mode int, mode_string string, owner_id bigint, group_id bigint, size decimal(20,0), atime {TIME}, mtime {TIME}, ctime {TIME}, btime {TIME}, link_target string, _error array<string>"
IMAGE = "path string, format string, media_size decimal(20,0), layers int, info map<string,string>, stored map<string,string>, acquisition_errors array<struct<first_sector:bigint,number:bigint>>, _error array<string>"
IMAGE_CHUNK = "path string, chunk_no bigint, media_offset decimal(20,0), bytes binary"
BLOCK_MAP = "path string, layer int, media_offset decimal(20,0), size decimal(20,0), data_offset decimal(20,0), data_size bigint, segment int, kind string, codec string"
VOLUME = "path string, scheme string, idx int, type_id string, uuid string, name string, `offset` decimal(20,0), size decimal(20,0), flags bigint, bytes_per_sector int, disk_identifier string, _error array<string>"
FILE_SYSTEM = "path string, volume int, format string, info map<string,string>, _error array<string>"
FILE_ENTRY = f"path string, layers {LAYERS}, volume int, display_path string, path_components array<string>, raw_name binary, name string, identifier string, file_type string, mode_string string, mode int, attributes bigint, owner_id bigint, group_id bigint, size decimal(20,0), atime {TIME}, mtime {TIME}, ctime {TIME}, btime {TIME}, link_target string, device struct<major:int,minor:int>, n_attributes int, n_forks int, is_root boolean, postorder bigint, md5 string, _error array<string>"
FILE_NAME = f"path string, volume int, identifier string, parent string, name string, name_space int, btime {TIME}, mtime {TIME}, ctime {TIME}, atime {TIME}, _error array<string>"
ATTRIBUTE = "path string, volume int, identifier string, idx int, kind string, name string, resident boolean, size decimal(20,0), value binary, runs array<struct<media_offset:decimal(20,0),size:decimal(20,0),data_offset:decimal(20,0)>>, _error array<string>"
DATA_FORK = "path string, volume int, display_path string, identifier string, fork_index int, fork_name string, size decimal(20,0), digest string, content binary, _error array<string>"
SCAN_NODE = "path string, node_id string, parent_id string, ordinal int, vfs_type string, location string, _error array<string>"
