"""Whole-matrix NumPy versions of the model equations, for comparison on small tables."""

import math

import numpy as np

EPS = 1e-10


def psi(x):
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        out -= 1.0 / y
        y = y + 1.0
    return out + np.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)


lgam = np.vectorize(math.lgamma)


def sigmoid(z):
    return np.clip(1 / (1 + np.exp(-np.clip(z, -500, 500))), EPS, 1 - EPS)


def floored_softmax(z, floor=EPS):
    e = np.exp(z - z.max(1, keepdims=True))
    r = e / e.sum(1, keepdims=True)
    if floor:
        r = np.maximum(r, floor)
        r /= r.sum(1, keepdims=True)
    return r


def beta_kl(a, b, a0, b0):
    s, s0 = a + b, a0 + b0
    return (lgam(s0) - lgam(a0) - lgam(b0) - lgam(s) + lgam(a) + lgam(b)
            + (a - a0) * (psi(a) - psi(s)) + (b - b0) * (psi(b) - psi(s)))


def dirichlet_kl(v, c):
    v = np.asarray(v, float)
    return (math.lgamma(c * len(v)) - len(v) * math.lgamma(c) - math.lgamma(v.sum()) + lgam(v).sum()
            + ((v - c) * (psi(v) - psi(v.sum()))).sum())


class Dense:
    """One model of a conjugate fit, full matrices."""

    def __init__(self, x, spec, p, labels):
        self.x, self.spec, self.p = np.asarray(x, float), spec, p
        n, s = self.x.shape
        k = p["k_max"]
        self.r = np.eye(k)[labels]
        member = self.r > 0.1
        if spec.start == "mean":
            lam = []
            for g in range(k):
                if member[:, g].any():
                    mu = self.x[member[:, g]].mean(0) + 0.5
                    lam.append(mu / mu.sum() * p["zeta"] * s)
                else:
                    lam.append(np.full(s, p["zeta"]))
            mu = self.x.mean(0) + 0.5
            self.lam, self.iota = np.maximum(lam, 0.1), np.maximum(mu / mu.sum() * p["eta"] * s, 0.1)
        else:
            self.lam = np.maximum(p["zeta"] + (self.r * member).T @ self.x, 0.1)
            self.iota = np.maximum(p["eta"] + self.x.mean(0) + 0.5, 0.1)
        self.sticks(first=True)
        shape = {"shared": s, "cluster": (k, s), "sample": (n, s)}.get(spec.selection, s)
        f0 = p["f0"]
        if spec.selection.startswith("ssl"):
            self.bt = max(s, 2) ** (1 + p["kappa"]) / math.log(max(s, 2))
            self.theta = 1 / (1 + self.bt)
            f0 = p["init_xi"] if spec.selection == "ssl" else max(self.theta, 1e-3)
        self.f, self.started = np.full(shape, float(f0)), False
        self.baseline = None

    def sticks(self, first=False):
        p, w, mass = self.p, self.spec.weights, self.r.sum(0)
        k = len(mass)
        after = mass[::-1].cumsum()[::-1] - mass
        idx = np.arange(1, k + 1)
        if w == "dp":
            self.a, self.b = (np.ones(k), np.full(k, p["nu"])) if first else (1 + mass, p["nu"] + after)
        elif w == "py":
            base = 1 - p["d"], p["theta"] + idx * p["d"]
            self.a, self.b = (np.full(k, base[0]), base[1]) if first else (base[0] + mass, base[1] + after)
        elif w == "nig":
            c = 1 - p["sigma"] + p["alpha"] / k
            self.a, self.b = c + mass, c + after
        else:
            groups = p["k_max"] if self.spec.frozen_groups else k
            self.a, self.b = p["delta"] + p["gamma"] / groups + mass, None

    def logs(self):
        self.ea = psi(self.lam) - psi(self.lam.sum(1, keepdims=True))
        self.eb = psi(self.iota) - psi(self.iota.sum())
        if self.b is None:
            self.lp = psi(self.a) - psi(self.a.sum())
        else:
            whole = psi(self.a + self.b)
            leave = psi(self.b) - whole
            self.lp = psi(self.a) - whole + np.concatenate([[0], leave.cumsum()[:-1]])

    def loglik(self, gated=True):
        if not gated:
            return self.x @ self.ea.T
        if self.spec.selection == "sample":
            return (self.f * self.x) @ self.ea.T + (((1 - self.f) * self.x) @ self.eb)[:, None]
        return self.x @ (self.f * self.ea + (1 - self.f) * self.eb).T

    def sweep(self, beta=1.0, gated=True):
        p, sel, n = self.p, self.spec.selection, len(self.x)
        self.logs()
        self.r = floored_softmax(beta * (self.lp + self.loglik(gated)))
        rx, colsum, old = self.r.T @ self.x, self.x.sum(0), self.f
        weight = {"shared": n, "cluster": n}.get(sel, 1.0)
        if sel in ("shared", "cluster", "sample"):
            xi = (p["xi_1"] + weight * old, p["xi_2"] + weight * (1 - old)) if self.started else (p["xi_1"], p["xi_2"])
            odds = psi(xi[0]) - psi(xi[1])
        if sel == "shared":
            new = sigmoid(odds + (rx * self.ea).sum(0) - colsum * self.eb)
        elif sel == "cluster":
            new = sigmoid(odds + rx * (self.ea - self.eb))
        elif sel == "sample":
            new = sigmoid(odds + self.x * (self.r @ self.ea - self.eb))
        else:
            ratio, slope = math.log(p["l1"] / p["l0"]), p["l0"] - p["l1"]
            rate = math.log(self.theta / (1 - self.theta))
            if sel == "ssl":
                g = (rx * self.ea).sum(0) - colsum * self.eb
                new = sigmoid(g + ratio + slope * np.maximum(g, 0) + rate)
            else:
                g = self.signal()
                level = self.null(g) if self.baseline is None else self.baseline
                target = sigmoid(ratio + slope * np.maximum(g - level, 0) + rate)
                ema = p["xi_ema"] if self.baseline is None else 1.0
                new = np.clip(ema * target + (1 - ema) * old, EPS, 1 - EPS)
        used = new if self.spec.select_first else old
        if sel == "ssl_excess":
            self.lam = np.maximum(p["zeta"] + rx, 0.1)
            rest = (1 - used) * colsum if gated else colsum
        elif sel == "sample":
            self.lam = np.maximum(p["zeta"] + self.r.T @ (used * self.x), 0.1)
            rest = ((1 - used) * self.x).sum(0)
        else:
            self.lam = np.maximum(p["zeta"] + used * rx, 0.1)
            rest = ((1 - used) * rx).sum(0) if sel == "cluster" else (1 - used) * colsum
        self.iota = np.maximum(p["eta"] + rest, 0.1)
        self.f, self.started = new, True
        if sel.startswith("ssl"):
            self.theta = (1 + new.sum()) / (1 + self.bt + len(new))
        self.sticks()
        return self

    def signal(self):
        return self.r.mean(0) @ np.abs(self.ea - self.eb)

    def null(self, g):
        share = min(max(3 * self.theta, 0.05), 0.4)
        return np.percentile(g, min(max(100 * (1 - share), 50), 90))

    def fast(self):
        return (self.r * (self.lp + self.loglik())).sum() - (self.r * np.log(np.maximum(self.r, EPS))).sum()

    def weights_kl(self):
        p, k = self.p, len(self.a)
        if self.spec.weights == "mfm":
            de = p["delta"] + p["gamma"] / (p["k_max"] if self.spec.frozen_groups else k)
            return dirichlet_kl(self.a, de)
        if self.spec.weights == "nig":
            return beta_kl(self.a, self.b, 1 - p["sigma"], 1 - p["sigma"]).sum()
        return beta_kl(self.a, self.b, 1 - p["d"], p["theta"] + np.arange(1, k + 1) * p["d"]).sum()

    def selection_kl(self):
        p = self.p
        n = len(self.x) if self.spec.selection == "shared" else 1.0
        return beta_kl(p["xi_1"] + n * self.f, p["xi_2"] + n * (1 - self.f), p["xi_1"], p["xi_2"]).sum()

    def full(self):
        """Objective with all KL terms and fresh logs."""
        self.logs()
        value = self.fast() - self.weights_kl() - self.selection_kl()
        value -= sum(dirichlet_kl(row, self.p["zeta"]) for row in self.lam) + dirichlet_kl(self.iota, self.p["eta"])
        unit = self.lam / np.linalg.norm(self.lam, axis=1, keepdims=True)
        gram = unit @ unit.T
        return value - self.p.get("repulsion", 0.0) * (gram[np.triu_indices(len(gram), 1)] ** 2).sum()


