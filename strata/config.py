"""Scene parameters, the constants derived from them, and the frame of a map."""

from __future__ import annotations

import dataclasses
import math


@dataclasses.dataclass(frozen=True)
class Scene:
    """Metres and costs. The first nine describe raster and robot, the rest planning on the graph."""

    resolution: float = 0.1
    ground_h: float = -1.0
    slice_dh: float = 0.5
    kernel_size: int = 5
    interval_min: float = 0.5
    interval_free: float = 0.6
    slope_max: float = 1.0
    step_max: float = 0.5
    standable_ratio: float = 0.4
    cost_barrier: float = 50.0
    safe_margin: float = 0.15
    inflation: float = 0.15
    cost_threshold: float = 35.0
    gateway_cost: float = 8.0
    gateway_height: float = 0.1
    edge_step: float = 0.5
    cost_weight: float = 0.2
    snap_radius: int = 80
    lift: float = 0.3
    flat_slope: float = 0.2
    min_nodes: int = 2000
    dedup_iou: float = 0.0
    merge_gap: float = 0.5

    @property
    def half_window(self) -> int:
        return (self.kernel_size - 1) // 2

    @property
    def half_inflation(self) -> int:
        """Truncated, not rounded: 0.3 / 0.1 gives 2."""
        return int((self.safe_margin + self.inflation) / self.resolution)

    @property
    def standable_least(self) -> int:
        return int(self.standable_ratio * (2 * self.half_window + 1) ** 2) - 1

    @property
    def stand_sq(self) -> float:
        return (1.2 * self.resolution * math.tan(self.slope_max)) ** 2

    @property
    def cross_sq(self) -> float:
        return self.step_max**2

    def inflation_offsets(self) -> list[tuple[int, int, float]]:
        """(dx, dy, score) of every offset at which a cost still weighs anything."""
        h, out = self.half_inflation, []
        for dx in range(-h, h + 1):
            for dy in range(-h, h + 1):
                d = math.hypot(dx * self.resolution, dy * self.resolution)
                score = min(1.0, max(0.0, 1 - (d - self.inflation) / (self.safe_margin + self.resolution)))
                if score > 0:
                    out.append((dx, dy, score))
        return out


@dataclasses.dataclass(frozen=True)
class Frame:
    """The one-row header of a map: centre, cells along x and y, slices, first slice height."""

    center_x: float
    center_y: float
    dim_x: int
    dim_y: int
    n_slice: int
    slice_h0: float
    slice_dh: float
    resolution: float

    def heights(self) -> list[float]:
        return [self.slice_h0 + s * self.slice_dh for s in range(self.n_slice)]
