"""Explicit schemas of the engine's tables."""

from __future__ import annotations

# Names and types of the sweep table's 18 base fields, in file order.
SWEEP_FIELDS: tuple[tuple[str, str], ...] = (
    ("N", "int"),
    ("runtime_s", "double"),
    ("actual_N", "int"),
    ("FAE", "double"),
    ("BDV", "double"),
    ("GED", "double"),
    ("MDV", "double"),
    ("LFS", "double"),
    ("intra_sp_var_mean", "double"),
    ("intra_sp_var_std", "double"),
    ("boundary_recall_mean", "double"),
    ("temporal_br_std", "double"),
    ("E_super_est", "bigint"),
    ("VRAM_est_MB", "double"),
    ("avg_sp_area", "double"),
    ("event_id", "string"),
    ("lifecycle_class", "string"),
    ("J_imex", "double"),
)

# The catalogue of frames, one row per event and channel.
CATALOG_SCHEMA = "id string, img_type string, file_name string, time_utc timestamp, pct_missing double, llcrnrlon double, urcrnrlon double, llcrnrlat double, urcrnrlat double"

# One row per frame of a channel, pixels row by row.
FRAMES_SCHEMA = "event_id string, channel string, t int, h int, w int, data array<float>"

# Point observations.
FLASHES_SCHEMA = "event_id string, t_off double, lat double, lon double, energy double"

# The event catalogue's columns in order.
EVENT_CATALOGUE_COLUMNS = (
    "id", "slope", "r_squared", "slope_norm", "n_phases", "phase_sequence", "peak_mass", "peak_frame", "trough_mass", "mean_mass",
    "active_fraction_t0", "n_cells_t0", "max_cell_area_t0", "spatial_type", "lifecycle_class", "intensity_percentile",
    "duration_frames", "recommended_N_hint",
)
