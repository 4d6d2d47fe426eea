from tessera.sources.tables import read_table
from tessera.sources.world import World

__all__ = ["read_table", "World"]
