"""Parameter objects.  A one-row settings table becomes a frozen dataclass whose
fields are folded into plans as literals (no join against a settings table)."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class ViewParams:
    # Fixed values that must equal the reference's renderer settings.
    fov: float = math.pi / 3
    step: float = 0.1
    max_steps: int = 100
    view_w: int = 128
    view_h: int = 64
    # True keeps the inclusive series 0..view_w / 0..view_h (129 x 65 generated).
    inclusive_edge: bool = True

    @property
    def ray_length(self) -> float:
        return self.max_steps * self.step

    @property
    def projection_factor(self) -> float:
        return self.view_w / (2 * math.tan(self.fov / 2))

    @property
    def reach(self) -> int:
        """Cells on each side of floor(position) that a ray can enter: it is at most
        ``ray_length`` long and its end is rounded to a cell."""
        return math.ceil(self.ray_length) + 1

    def frame_radius(self, world_w):
        """Distance beyond which a target ``world_w`` wide (a number or a Column) leaves no
        pixel: it is drawn nearer than the ray length, and its centre is at most half a
        screen plus half its own width beside the line of sight.  Three columns are
        allowed for rounding and for texels widened to one pixel."""
        side = self.ray_length * (self.view_w / 2 + 3) / self.projection_factor
        return ((side + world_w / 2) * (side + world_w / 2) + self.ray_length ** 2) ** 0.5


@dataclass(frozen=True)
class StateParams:
    # Fixed values that must equal the reference's gameplay config.
    move_speed: float = 0.3
    turn_speed: float = 0.2
    ammo_max: int = 10
    refill_interval_s: int = 2
    projectile_speed: float = 0.5
    projectile_size: float = 0.5
    damage: int = 50
    hp_full: int = 100
    spawn_x: float = 4.0
    spawn_y: float = 4.0
    spawn_dir: float = 0.0
    # Fixed LOD thresholds (strict ">"): projectile far beyond 4, player far beyond 6,
    # player mid beyond 3.
    lod_projectile_far: float = 4.0
    lod_player_far: float = 6.0
    lod_player_mid: float = 3.0


@dataclass(frozen=True)
class WorldParams:
    """Layout of the fixture world derived from the driver tables.

    Every block of ``parts_per_band`` part keys carves rooms into its own
    ``tile_w x tile_h`` band, so the world (and all work on it) grows with the data.
    """

    tile_w: int = 256
    tile_h: int = 128
    parts_per_band: int = 200
    min_room: int = 6          # rooms at least 6 x 6 get a respawn cell
    respawn_seed: int = 17
    refill_interval_s: int = 3600
    quota_max: int = 3
