"""Plain-Python sequential fold: the independent oracle for O1-O4 and L4."""


def fold(clicks):
    """clicks: dicts with tile_id, country_id, timestamp_ns, arrival_ns, click_id.
    Returns (per-click results keyed by click_id, final owners, leaderboard)."""
    state, out = {}, {}
    for c in sorted(clicks, key=lambda r: (r["arrival_ns"], r["click_id"])):
        prev = state.get(c["tile_id"])
        applied = prev is None or c["timestamp_ns"] > prev[1]
        out[c["click_id"]] = (applied, prev[0] if prev else None, prev[1] if prev else None)
        if applied:
            state[c["tile_id"]] = (c["country_id"], c["timestamp_ns"])
    board = {}
    for country, _ in state.values():
        board[country] = board.get(country, 0) + 1
    return out, state, board
