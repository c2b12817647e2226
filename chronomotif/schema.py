"""Schemas of the tables that operators exchange."""

EVENTS = "event_id long, start long, end long, src long, dst long, etype int"
NODE_TYPES = "node long, ntype int"
EDGE = "struct<src:bigint,dst:bigint,etype:int>"
REPORT = (
    "count long, ref_avg double, ratio double, ref_std double, n_ref int, n_lt_ref int, z_score double, "
    "n_loc_tot long, n_loc long, n_loc_ref double, motif string"
)
EDGES = "u string, v string, w double"
MEMBERSHIP = "node string, comm long"
