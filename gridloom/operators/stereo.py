"""Stereo disparity: matching costs smoothed by a guided filter, and the cheapest shift of each pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .stencils import box_mean
from .tiles import Arrays, tiled


def disparity(pair: DataFrame, most: int, radius: int = 4, eps: float = 1e-4, gradient: float = 0.9, cut_color: float = 0.03, cut_gradient: float = 0.01, side: int = 128) -> DataFrame:
    """(x, y, z, v): how far, 0 to `most`, each pixel of the left image is shifted in the right one.

    pair: (x, y, z, l, r), lists of three channels of both images in 0 .. 1. The cost of a shift is a blend of cut differences
    of colour and of the gradient along x; pixels whose match is outside cost the cuts. Costs are smoothed by the
    linear model of the left image's colours in the box around each pixel. Of equal costs the greater shift counts.
    """

    def kernel(a: Arrays) -> Arrays:
        left, right = (np.nan_to_num(a[k]) for k in "lr")
        slope = [np.gradient(c.mean(axis=0), axis=0) if c.shape[1] > 1 else np.zeros(c.shape[1:]) for c in (left, right)]
        mean = np.stack([box_mean(c, radius) for c in left])
        cov = np.empty((*left.shape[1:], 3, 3))
        for i in range(3):
            for j in range(3):
                cov[..., i, j] = box_mean(left[i] * left[j], radius) - mean[i] * mean[j]
        inverse = np.linalg.inv(cov + eps * np.eye(3))
        best = np.full(left.shape[1:], np.inf)
        out = np.zeros(left.shape[1:])
        for d in range(most + 1):
            cost = np.full(left.shape[1:], (1 - gradient) * cut_color + gradient * cut_gradient)
            if d < left.shape[1]:
                n = left.shape[1] - d
                color = np.minimum(np.abs(left[:, d:] - right[:, :n]).mean(axis=0), cut_color)
                cost[d:] = (1 - gradient) * color + gradient * np.minimum(np.abs(slope[0][d:] - slope[1][:n]), cut_gradient)
            m = box_mean(cost, radius)
            cross = np.stack([box_mean(left[i] * cost, radius) - mean[i] * m for i in range(3)], axis=-1)
            k = np.einsum("...ij,...j->...i", inverse, cross)
            b = m - sum(k[..., i] * mean[i] for i in range(3))
            smooth = sum(box_mean(k[..., i], radius) * left[i] for i in range(3)) + box_mean(b, radius)
            out = np.where(smooth <= best + 1e-12, d, out)
            best = np.minimum(best, smooth)
        return {"v": out}

    halo = 2 * radius + most + 1
    return tiled(pair, kernel, ["l", "r"], {"v": "long"}, (halo, 2 * radius, 0), max(side, halo))
