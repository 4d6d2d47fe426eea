from tessera.functions.num import cell, col, explode_range, floor_cell, idiv, q6, safe_seq
from tessera.functions.joins import bounded_broadcast

__all__ = ["cell", "col", "explode_range", "floor_cell", "idiv", "q6", "safe_seq", "bounded_broadcast"]
