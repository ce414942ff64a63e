"""Sources and sinks."""

from .publish import is_fresh, line_points, prune, publish, register, to_box  # noqa: F401
from .readings import bilinear, csv_readings, increments, json_members, manifest, pick, polygons, quality_gate, read_key, require_columns, write_by_key, write_documents  # noqa: F401
