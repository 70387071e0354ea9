"""Saving and loading of factors, densities, graphs and models, and the callback that saves every step. A name with a scheme (hdfs://, s3a://,
file://) is a folder of JSON and Parquet on that file system, which holds training tables as well; another name is a local pickle."""

from __future__ import annotations

import os
import pickle

from netloom.sources.folder import load_folder, save_folder


def save(obj, filename: str, include_cpd: bool | None = None) -> str:
    """A folder, or pickle protocol 2, to whose name the suffix .pickle is added if it is missing. Models without include_cpd lose their fitted
    factors."""
    before = getattr(obj, "include_cpd", None)
    if include_cpd is not None and before is not None:
        obj.include_cpd = include_cpd
    try:
        if "://" in filename:
            return save_folder(obj, filename)
        data = pickle.dumps(obj, 2)
    finally:
        if before is not None:
            obj.include_cpd = before
    name = filename if filename.endswith(".pickle") else f"{filename}.pickle"
    with open(name, "wb") as f:
        f.write(data)
    return name


def load(filename: str):
    """A folder, which is data only, or a pickle, which only those should load who trust it."""
    if "://" in filename:
        return load_folder(filename)
    with open(filename, "rb") as f:
        return pickle.load(f)  # noqa: S301


class SaveModel:
    """Callback: writes {iteration:06d}.pickle into a folder, or a folder {iteration:06d} into one with a scheme."""

    def __init__(self, folder: str):
        self.folder = folder
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)

    def call(self, model, operator, score, num_iter: int) -> None:
        save(model, f"{self.folder.rstrip('/')}/{num_iter:06d}" if "://" in self.folder else os.path.join(self.folder, f"{num_iter:06d}.pickle"))
