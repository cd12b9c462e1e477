"""What distinguishes the fits: prior, selection rule, order of updates, defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The defaults of all fits.
COMMON = dict(
    k_max=10, zeta=1.0, eta=1.0, xi_1=1.0, xi_2=1.0, f0=0.3, tol=1e-4, max_iter=500,
    prune_threshold=0.02, min_clusters=None, prune_start=10, prune_every=5,
    nu="auto", d=0.0, theta="auto", delta=1.0, gamma=1.0, sigma=0.5, alpha=1.0,
)


@dataclass(frozen=True)
class Spec:
    name: str
    weights: str  # dp | py | mfm | nig
    selection: str  # shared | cluster | sample | ssl | ssl_excess
    select_first: bool = True  # selection is updated before the profiles
    start: str = "mean"  # rule of the starting profiles
    frozen_groups: bool = False  # Dirichlet prior keeps the starting number of groups
    min_size: str = "adaptive"  # adaptive: max(1, N / 5K); one: more than one sample
    objective: str = "fast"  # fast | weights (minus KL of weights and selection) | ssl
    stop: str = "pruned"  # pruned | after_start | after_moves | after_anneal | rate
    theta_auto: str = "1/k"
    anneal: str | None = None  # linear | thermal | density
    moves: tuple[str, ...] = ()
    choose: str = "elbo"  # elbo | icl: how restarts are compared
    defaults: dict = field(default_factory=dict)

    def params(self, **given) -> dict:
        """Defaults with the given values, 'auto' entries resolved."""
        p = {**COMMON, **self.defaults, **given}
        unknown = set(given) - set(COMMON) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} does not take {sorted(unknown)}")
        if p["nu"] in ("auto", None):
            p["nu"] = 1.0 / p["k_max"]
        if p["theta"] in ("auto", None):
            p["theta"] = 1.0 / p["k_max"] if self.theta_auto == "1/k" else 1.0
        if p["min_clusters"] is None:
            p["min_clusters"] = max(2, p["k_max"] // 5)
        if self.weights == "py" and p["theta"] <= -p["d"]:
            raise ValueError(f"concentration {p['theta']} must exceed {-p['d']}")
        return p

    def per_sample(self, on: bool) -> Spec:
        return replace(self, selection="sample" if on else "shared")


# Defaults of the fits with moves and of the spike-and-slab fits.
_MOVES = dict(
    k_max=15, f0=0.3, max_iter=400, beta_start=0.2, beta_end=1.0, anneal_iters=60, merge_every=15, n_restarts=3
)
_SSL = dict(l0=50.0, l1=1.0, kappa=0.1, init_xi=0.3)

FITS: dict[str, Spec] = {
    s.name: s
    for s in (
        Spec("dp", "dp", "shared"),
        Spec("dp_cluster", "dp", "cluster"),
        Spec("py", "py", "sample", min_size="one", objective="weights", stop="after_start",
             defaults=dict(prune_threshold=0.01)),
        Spec("mfm", "mfm", "sample", select_first=False, min_size="one", objective="weights", stop="after_start",
             defaults=dict(prune_threshold=0.01)),
        Spec("nig", "nig", "sample", select_first=False, min_size="one", objective="weights", stop="after_start",
             defaults=dict(prune_threshold=0.01)),
        Spec("py_moves", "py", "sample", select_first=False, start="sum", stop="after_moves", theta_auto="1",
             anneal="linear", moves=("merge", "delete"),
             defaults={**_MOVES, "d": 0.2, "zeta": 0.5, "eta": 0.5}),
        Spec("mfm_moves", "mfm", "sample", select_first=False, start="sum", frozen_groups=True, stop="after_moves",
             anneal="linear", moves=("split", "merge_gated", "delete"), choose="icl",
             defaults={**_MOVES, "gamma": 2.0, "zeta": 0.1, "eta": 0.1, "xi_1": 2.0, "f0": 0.5}),
        Spec("nig_moves", "nig", "sample", select_first=False, start="sum", stop="after_moves",
             anneal="linear", moves=("split", "merge_gated", "delete"), choose="icl",
             defaults={**_MOVES, "zeta": 0.1, "eta": 0.1, "xi_1": 2.0, "f0": 0.5, "repulsion": 0.2}),
        Spec("ssl", "dp", "ssl", objective="ssl", defaults=_SSL),
        Spec("ssl_excess", "dp", "ssl_excess", objective="ssl", stop="rate",
             defaults={**_SSL, "l0": 100.0, "xi_ema": 0.5, "burn_in": 20, "tol": 1e-3, "max_iter": 300}),
        Spec("dp_thermal", "dp", "shared", stop="after_anneal", anneal="thermal",
             defaults=dict(beta0=0.01, s0=0.0, tau1=1, tau2=150)),
        Spec("dp_density", "dp", "shared", stop="after_anneal", anneal="density",
             defaults=dict(beta0=30.0, s0=1.0, tau1=100, tau2=200, max_iter=600)),
    )
}


def linear_anneal(t: int, start: float, end: float, iters: int) -> float:
    """Inverse temperature at round t (from 1): a line from start to end over ``iters`` rounds."""
    if start < 1.0 and t <= iters:
        return start + (end - start) * (t - 1) / max(iters - 1, 1)
    return end


def two_phase_anneal(t: int, beta0: float, s0: float, tau1: int, tau2: int) -> tuple[float, float]:
    """(beta, s) at round t (from 0): s falls to 0 by tau1, then beta goes from beta0 to 1 by tau2."""
    s = s0 * max(1.0 - t / tau1, 0.0)
    if t <= tau1:
        return beta0, s
    if t <= tau2:
        return 1.0 + (beta0 - 1.0) * (tau2 - t) / (tau2 - tau1), s
    return 1.0, s


def step_size(t: int, offset: float = 10.0, power: float = 0.7) -> float:
    return (t + offset) ** (-power)


def remap_concentration(c: float) -> tuple[float, bool]:
    """Concentration actually used, and whether more groups are wanted."""
    if c < 0.1:
        return 0.5, True
    return (1.0, True) if c < 1.0 else (c, False)


def relative_changes(values: list[float], last: int) -> list[float]:
    recent = values[-last - 1:]
    return [abs(b - a) / (abs(b) + 1e-10) for a, b in zip(recent, recent[1:])]
