"""Parameters of the pipeline, with the two presets in use: a library call's and an interactive session's."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class PipelineParams:
    channel_shifts: tuple[int, int, int, int] = (0, 0, 0, 0)
    baseline_method: str = "rolling"
    baseline_win: int = 101
    sg_win: int = 19
    sg_poly: int = 3
    sg_passes: int = 1
    sg_mode: str = "interp"
    sigma: float = 0.4
    amount: float = 0.0
    prom: float = 0.002
    dist: int = 2
    merge_tol: int = 2
    min_snr: float = 1.0
    min_isolation: float = 1.15
    mobility_enabled: bool = True
    auto_trim_blob: bool = True
    suppress_n1: bool = True
    use_spacing_model: bool = True
    detect_missing: bool = True
    use_adaptive_peaks: bool = True
    allow_uncertain: bool = True
    detect_het: bool = False
    het_threshold: float = 0.45
    primer_sequence: str = ""
    window_trim_min_q: float = 20.0
    window_trim_size: int = 20
    noise_floor_window: int = 51
    noise_floor_percentile: float = 5.0
    matrix: tuple[tuple[float, ...], ...] = field(default=((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)))

    @classmethod
    def library(cls, **changes) -> "PipelineParams":
        return cls().but(**changes)

    @classmethod
    def interactive(cls, **changes) -> "PipelineParams":
        return cls(baseline_method="morph", prom=0.004, dist=4, merge_tol=3, min_snr=1.5, min_isolation=1.2).but(**changes)

    def but(self, **changes) -> "PipelineParams":
        """A copy with changes; names that aren't parameters are left out."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    def __post_init__(self):
        if self.sg_win % 2 == 0:
            object.__setattr__(self, "sg_win", self.sg_win - 1)  # an even window is rounded down
