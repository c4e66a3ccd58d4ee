"""Molecules as columns, through a backend: RDKit if it is installed, or any
object with the same five methods.

Backends run in Python workers on Arrow batches, one per worker and batch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and radius of a fingerprint.
WIDTH, RADIUS = 2048, 2


class Backend(Protocol):
    def parse(self, smiles: str): ...  # None if it isn't a molecule
    def canonical(self, molecule) -> str: ...
    def bits(self, molecule) -> list[int]: ...  # of WIDTH, those that are set
    def weight(self, molecule) -> float: ...
    def descriptors(self, molecule, names: list[str]) -> list[float]: ...


class Rdkit:
    """Needs RDKit, which is imported where it runs."""

    def __init__(self):
        from rdkit import Chem
        from rdkit.Chem import Descriptors, rdFingerprintGenerator

        self._chem, self._all = Chem, dict(Descriptors.descList)
        self._generator = rdFingerprintGenerator.GetMorganGenerator(radius=RADIUS, fpSize=WIDTH)

    def parse(self, smiles):
        return self._chem.MolFromSmiles(smiles)

    def canonical(self, molecule):
        return self._chem.MolToSmiles(molecule)

    def bits(self, molecule):
        return list(self._generator.GetFingerprint(molecule).GetOnBits())

    def weight(self, molecule):
        return float(self._all["MolWt"](molecule))

    def descriptors(self, molecule, names):
        return [float(self._all[n](molecule)) for n in names]


def check_names(names: list[str], known: list[str]) -> None:
    """Raises for descriptors that are unknown or named twice, before any row is read."""
    if missing := sorted(set(names) - set(known)):
        raise ValueError(f"unknown descriptors: {', '.join(missing)}")
    if len(set(names)) < len(names):
        raise ValueError("a descriptor is named twice")


def described(smiles: Column, make: Callable[[], Backend], names: list[str] | None = None, empty_is_valid: bool = False) -> Column:
    """A struct of a molecule: valid, canonical, words (packed fingerprint), n (bits
    set), weight and values (of the named descriptors).  An invalid one has nulls.
    An empty or null text is invalid, or, for workloads that parse it, empty text is
    a molecule without atoms."""
    names = names or []

    @F.pandas_udf("valid boolean, canonical string, words array<long>, n int, weight double, values array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        chem, out = make(), []
        for t in texts:
            m = chem.parse(t) if isinstance(t, str) and (t or empty_is_valid) else None
            if m is None:
                out.append((False, None, None, None, None, None))
                continue
            on = np.array(sorted(chem.bits(m)), np.int64)
            words = np.zeros(WIDTH // 64, np.uint64)
            np.bitwise_or.at(words, on // 64, np.uint64(1) << (on % 64).astype(np.uint64))
            out.append((True, chem.canonical(m), words.view(np.int64), len(on), float(chem.weight(m)), chem.descriptors(m, names)))
        frame = pd.DataFrame(out, columns=["valid", "canonical", "words", "n", "weight", "values"])
        return frame.assign(n=frame["n"].astype("Int32"))

    return run(smiles)
