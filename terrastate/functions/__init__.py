from terrastate.functions.scalar import (
    display_label,
    display_name,
    epoch_ns,
    flag_emoji,
    lower_code,
    name_matches,
    norm3,
    percent_of,
    uv_to_lat,
    uv_to_lon,
    xyz_to_u,
    xyz_to_v,
)

__all__ = [
    "display_label", "display_name", "epoch_ns", "flag_emoji", "lower_code", "name_matches", "norm3",
    "percent_of", "uv_to_lat", "uv_to_lon", "xyz_to_u", "xyz_to_v",
]
