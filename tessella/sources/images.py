"""Preparation of page images: fixed steps in a fixed order, each an injected function on one image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The order of the steps; a page turned by less than LEAST_TURN degrees is left as it is.
STEPS, LEAST_TURN, MOST_TURN = ("deskew", "denoise", "threshold", "upscale"), 0.2, 15.0


def skew(angles: list[float]) -> float:
    """The skew of a page from the angles of its lines, in degrees: the median of those near an axis; 0 without any."""
    folded = sorted(f for f in ((a + 45) % 90 - 45 for a in angles) if abs(f) <= MOST_TURN)
    n = len(folded)
    return 0.0 if not n else (folded[(n - 1) // 2] + folded[n // 2]) / 2


def prepared(pages: DataFrame, steps: dict[str, Callable[[bytes], bytes]], lines: Callable[[bytes], list[float]] | None = None) -> DataFrame:
    """``pages`` (page_id, image) with the image after the given steps, the ``turn`` that was undone, and ``error``.

    ``steps`` maps names of STEPS to functions of an image; ``deskew`` takes (image, degrees) and runs only with ``lines``,
    which gives the angles of the lines of a page. A page that fails keeps its image and has an error.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, image in zip(batch["page_id"], batch["image"], strict=True):
                done, turn, error = image, 0.0, None
                try:
                    for name in STEPS:
                        if name == "deskew" and name in steps and lines is not None:
                            turn = skew(lines(done))
                            done, turn = (steps[name](done, turn), turn) if abs(turn) >= LEAST_TURN else (done, 0.0)
                        elif name != "deskew" and name in steps:
                            done = steps[name](done)
                except Exception as failed:  # one bad page must not stop the others
                    done, turn, error = image, 0.0, f"{type(failed).__name__}: {failed}"
                out.append((page, done, turn, error))
            yield pd.DataFrame(out, columns=["page_id", "image", "turn", "error"])

    return pages.select("page_id", "image").mapInPandas(run, "page_id long, image binary, turn double, error string")
