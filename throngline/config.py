"""Scene description and thresholds: plain frozen values, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

Point = tuple[float, float]


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values of the rules; any of them can be replaced per query."""

    band_busy: float = 2.0
    band_crowded: float = 3.0
    band_very_crowded: float = 4.0
    band_critical: float = 5.0
    trend_window_s: float = 60.0
    trend_rising_rate: float = 0.12
    ttc_amber_s: float = 300.0
    ttc_red_s: float = 120.0
    free_speed_ms: float = 1.0
    slow_speed_ms: float = 0.35
    breakdown_density: float = 2.0
    breakdown_speed_drop: float = 0.35
    pressure_amber: float = 0.60
    pressure_red: float = 1.20
    convergence_amber: float = 0.45
    convergence_red: float = 0.70
    corridor_clear: float = 1.0
    corridor_restricted: float = 2.0
    dwell_s: float = 25.0
    resolve_s: float = 45.0
    reassert_gap_s: float = 120.0


@dataclass(frozen=True)
class Region:
    """A zone or a corridor: a polygon in frame pixels."""

    id: str
    name: str
    polygon: tuple[Point, ...]
    neighbors: tuple[str, ...] = ()
    kind: str = "zone"

    def __post_init__(self):
        if len(self.polygon) < 3:
            raise ValueError(f"region {self.id}: a polygon has at least three corners")


@dataclass(frozen=True)
class Scene:
    name: str
    frame_size: tuple[int, int]
    regions: tuple[Region, ...]
    image_points: tuple[Point, ...] = ()
    world_points: tuple[Point, ...] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        if {len(self.image_points), len(self.world_points)} - {0, 4}:
            raise ValueError("a calibration has four points, or none")

    @property
    def zones(self) -> tuple[Region, ...]:
        return tuple(r for r in self.regions if r.kind == "zone")

    @property
    def corridors(self) -> tuple[Region, ...]:
        return tuple(r for r in self.regions if r.kind == "corridor")

    def scaled(self, width: int, height: int) -> Scene:
        """The scene for frames of another size."""
        sx, sy = width / self.frame_size[0], height / self.frame_size[1]
        move = lambda points: tuple((x * sx, y * sy) for x, y in points)
        regions = tuple(Region(r.id, r.name, move(r.polygon), r.neighbors, r.kind) for r in self.regions)
        return Scene(self.name, (width, height), regions, move(self.image_points), self.world_points, self.thresholds)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Scene:
        d = json.loads(text)
        points = lambda key: tuple(map(tuple, d.get(key) or ()))
        regions = tuple(Region(r["id"], r["name"], tuple(map(tuple, r["polygon"])), tuple(r.get("neighbors") or ()), r.get("kind", "zone")) for r in d["regions"])
        known = {f.name for f in fields(Thresholds)}
        return Scene(d["name"], tuple(d["frame_size"]), regions, points("image_points"), points("world_points"), Thresholds(**{k: v for k, v in (d.get("thresholds") or {}).items() if k in known}))


def box(x0: float, y0: float, x1: float, y1: float) -> tuple[Point, ...]:
    return ((x0, y0), (x1, y0), (x1, y1), (x0, y1))


#: A frame of 960 x 544 pixels over 30 m x 17 m of ground.
DEFAULT_SCENE = Scene(
    "riverside",
    (960, 544),
    (
        Region("ghat_west", "West steps", box(0, 0, 448, 192), ("ghat_east", "west_approach")),
        Region("ghat_east", "East steps", box(448, 0, 960, 192), ("ghat_west", "gate_approach")),
        Region("gate_approach", "Main gate approach", box(496, 192, 848, 307), ("ghat_east", "exit_apron", "west_approach")),
        Region("west_approach", "West gate approach", box(32, 192, 320, 307), ("ghat_west", "exit_apron", "gate_approach")),
        Region("exit_apron", "Exit apron", box(0, 320, 960, 544), ("gate_approach", "west_approach")),
        Region("main_gate", "Main gate", box(624, 272, 720, 352), kind="corridor"),
        Region("west_corridor", "West corridor", box(120, 272, 200, 352), kind="corridor"),
    ),
    box(0, 0, 960, 544),
    box(0, 0, 30, 17),
)
