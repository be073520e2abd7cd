"""Fixed schemas of the canonical tables; readers validate against these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


SCHEMAS: dict[str, str] = {
    "runs": "run_id STRING, date STRING, subject STRING, run STRING, fov STRING, frame_rate DOUBLE, "
    "skip_s DOUBLE, has_second_channel BOOLEAN, mask_source STRING, genotype STRING, uncertain BOOLEAN, "
    "vz_um DOUBLE, vy_um DOUBLE, vx_um DOUBLE, nz INT, ny INT, nx INT",
    "frames": "run_id STRING, channel STRING, t INT, z INT, y INT, vals ARRAY<FLOAT>",
    "voxel_traces": "run_id STRING, channel STRING, z INT, y INT, x INT, trace ARRAY<FLOAT>",
    "mask_voxels": "run_id STRING, source STRING, unit STRING, z INT, y INT, x INT",
    "regions": "run_id STRING, source STRING, unit STRING, region STRING, z INT, y INT, x INT",
    "traces": "run_id STRING, source STRING, unit STRING, frame INT, time_s DOUBLE, dff DOUBLE",
    "global_trace": "run_id STRING, time_s DOUBLE, global_dff DOUBLE",
    "behavior": "run_id STRING, signal STRING, time_s DOUBLE, value DOUBLE",
    "triggers": "run_id STRING, time_s DOUBLE, line STRING, level INT",
    "mask_manifest": "dend_id INT, labelmap_path STRING, background_path STRING, source_event_file STRING, "
    "event_t_start INT, event_t_end INT, voxel_size_z DOUBLE, voxel_size_y DOUBLE, voxel_size_x DOUBLE, "
    "volume_um3 DOUBLE",
    "curation_log": "name STRING, kept INT, out STRING",
    "merge_log": "new_name STRING, rep STRING, merged STRING, group_size INT, volume INT, timestamp STRING",
    "metrics_long": "run_id STRING, mouse STRING, fov STRING, genotype STRING, uncertain BOOLEAN, "
    "family STRING, metric STRING, value DOUBLE",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def validate(df: DataFrame, name: str) -> DataFrame:
    """Select the declared columns in order; a missing or mistyped one is an error at plan time."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema(name).fields:
        if field.name not in have:
            raise ValueError(f"{name}: column {field.name} is missing")
        if have[field.name] != field.dataType:
            raise ValueError(f"{name}.{field.name}: {have[field.name]} instead of {field.dataType}")
    return df.select(*[f.name for f in schema(name).fields])
