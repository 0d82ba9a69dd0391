"""Poses of scans: rotations, and a graph of relative poses.

A survey has at most some thousands of scans, so these are small systems that the
driver solves; what feeds them comes from Spark.
"""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def so3_exp(w: np.ndarray) -> np.ndarray:
    """Rotation of a rotation vector."""
    t = np.linalg.norm(w)
    k = skew(w)
    if t < 1e-9:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(t) / t * k + (1 - np.cos(t)) / t**2 * k @ k


def so3_log(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation."""
    t = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    if t < 1e-7:
        return v
    if np.pi - t < 1e-5:
        a = np.sqrt(np.clip((np.diag(r) + 1) / 2, 0, None))
        k = int(a.argmax())
        axis = (r[k] + np.eye(3)[k]) / (2 * a[k])
        return t * axis / np.linalg.norm(axis)
    return t / np.sin(t) * v


def se3_exp(x: np.ndarray) -> np.ndarray:
    """Pose of a twist (translation, rotation)."""
    w = x[3:]
    t = np.linalg.norm(w)
    k = skew(w)
    v = np.eye(3) + k / 2 + k @ k / 6 if t < 1e-9 else np.eye(3) + (1 - np.cos(t)) / t**2 * k + (t - np.sin(t)) / t**3 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = so3_exp(w), v @ x[:3]
    return out


def se3_log(m: np.ndarray) -> np.ndarray:
    w = so3_log(m[:3, :3])
    t = np.linalg.norm(w)
    k = skew(w)
    v = np.eye(3) + k / 2 + k @ k / 6 if t < 1e-9 else np.eye(3) + (1 - np.cos(t)) / t**2 * k + (t - np.sin(t)) / t**3 * k @ k
    return np.concatenate([np.linalg.solve(v, m[:3, 3]), w])


def invert(m: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def adjoint(m: np.ndarray) -> np.ndarray:
    r = m[:3, :3]
    return np.block([[r, skew(m[:3, 3]) @ r], [np.zeros((3, 3)), r]])


def rotation_angle(m: np.ndarray) -> float:
    return float(np.degrees(np.linalg.norm(so3_log(m[:3, :3]))))


def kabsch_2d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Turn about z and shift that take points a to b in the plane, heights by their mean."""
    ma, mb = a.mean(0), b.mean(0)
    u, v = a - ma, b - mb
    t = np.arctan2((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum(), (u[:, :2] * v[:, :2]).sum())
    out = np.eye(4)
    out[:2, :2] = [[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]
    out[:3, 3] = mb - out[:3, :3] @ ma
    return out


def transform_difference(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Turn (radians) and shift between two poses."""
    m = invert(a) @ b
    return float(np.linalg.norm(so3_log(m[:3, :3]))), float(np.linalg.norm(m[:3, 3]))


def solve_pose_graph(n: int, edges: list[tuple[int, int, np.ndarray, np.ndarray]], fixed: int = 0, rounds: int = 50, huber: float = 3.0) -> list[np.ndarray]:
    """Poses of n scans from relative ones: ``edges(i, j, pose of j in i, information)``.

    Damped least squares on the errors' twists with Huber weights; poses start
    from a spanning tree, and scans that no edge reaches stay at the origin.
    """
    poses: list[np.ndarray | None] = [None] * n
    poses[fixed] = np.eye(4)
    grown = True
    while grown:
        grown = False
        for i, j, m, _ in edges:
            if poses[i] is not None and poses[j] is None:
                poses[j], grown = poses[i] @ m, True
            elif poses[j] is not None and poses[i] is None:
                poses[i], grown = poses[j] @ invert(m), True
    held = [p if p is not None else np.eye(4) for p in poses]

    def error(ps):
        out = []
        for i, j, m, info in edges:
            e = se3_log(invert(m) @ invert(ps[i]) @ ps[j])
            d = float(np.sqrt(max(e @ info @ e, 0)))
            out.append((e, 1.0 if d <= huber else huber / d, d * d if d <= huber else 2 * huber * d - huber**2))
        return out

    damp = 1e-4
    now = error(held)
    for _ in range(rounds):
        h, g = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
        for (i, j, _, info), (e, w, _) in zip(edges, now, strict=True):
            ji = -adjoint(invert(held[j]) @ held[i])
            jj = np.eye(6)
            for a, ja in ((i, ji), (j, jj)):
                g[6 * a : 6 * a + 6] += w * ja.T @ info @ e
                for b, jb in ((i, ji), (j, jj)):
                    h[6 * a : 6 * a + 6, 6 * b : 6 * b + 6] += w * ja.T @ info @ jb
        free = np.ones(6 * n, bool)
        free[6 * fixed : 6 * fixed + 6] = False
        step = np.zeros(6 * n)
        step[free] = -np.linalg.solve(h[np.ix_(free, free)] + damp * np.eye(free.sum()), g[free])
        new = [p @ se3_exp(step[6 * k : 6 * k + 6]) for k, p in enumerate(held)]
        then = error(new)
        if sum(x[2] for x in then) < sum(x[2] for x in now):
            done = np.abs(step).max() < 1e-9
            held, now, damp = new, then, damp / 5
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    return held
