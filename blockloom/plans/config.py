"""Parameters of the vector-quantisation pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VQConfig:
    """Sizes and thresholds. The defaults, which results depend on."""

    width: int = 512
    height: int = 512
    block: int = 4
    codes: int = 64
    delta: float = 0.01
    epsilon: float = 0.0001
    max_iter: int = 100
    ssim_k1: float = 0.01
    ssim_k2: float = 0.03
    ssim_window: int = 11
    ssim_sigma: float = 1.5
    bilateral_size: int = 5
    sigma_color: float = 20.0
    sigma_space: float = 20.0
    alpha: float = 0.8
    peak: int = 255
    precision: str = "float32"

    def __post_init__(self) -> None:
        if self.codes < 1 or self.codes & (self.codes - 1) or self.codes > 256:
            raise ValueError("codes must be a power of two from 1 to 256")
        if self.width % self.block or self.height % self.block or self.width < 1 or self.height < 1:
            raise ValueError("width and height must be positive multiples of block")

    @property
    def length(self) -> int:
        return self.block * self.block
