"""Parameters of training, from Python or from a ``key=value`` file."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from grovelight.sources.tables import cut

#: File keys whose names differ from the field names.
FILE_KEYS = {
    "numFeatures": "num_features", "numClasses": "num_classes", "numTrees": "num_trees", "maxDepth": "depths", "binNumber": "bin_numbers",
    "featureMultiplierPerNode": "multipliers", "strategyFeature": "feature_strategy", "strategySplit": "split_strategy", "poissonMean": "poisson_mean",
    "rotation": "rotation", "numRotation": "num_rotations", "rotationRandomSeed": "rotation_seed", "modelSelection": "model_selection",
    "modelSelectionEpsilon": "epsilon", "modelSelectionEpsilonRemove": "epsilon_remove", "testAll": "test_all", "fcsActive": "local_active",
    "fcsDepth": "local_depth", "fcsActiveForce": "local_force", "outputTree": "output_tree", "logStats": "log_stats", "dataset": "dataset", "fileType": "file_type", "category": "category", "output": "output", "permitSparseWorkingData": "sparse",
    "skipAccuracy": "skip_accuracy", "maxNodesConcurrent": "max_nodes",
}


@dataclass(frozen=True)
class ForestParams:
    num_features: int = 2
    num_classes: int = 2
    num_trees: tuple[int, ...] = (10,)
    depths: tuple[int, ...] = (10,)
    bin_numbers: tuple[int, ...] = (32,)
    multipliers: tuple[float, ...] = (1.0,)
    feature_strategy: str | int = "sqrt"
    split_strategy: str = "distribution"
    poisson_mean: float | None = 1.0
    seed: int = 0
    rotation: bool = False
    num_rotations: int = 10
    rotation_seed: int = 0
    model_selection: bool = False
    epsilon: float = 0.0
    epsilon_remove: float = 1.0
    test_all: bool = False
    local_active: bool = True
    local_depth: int = -1
    local_force: bool = False
    local_rows: int = 20_000  # rows of a node that one task may finish
    local_memory: int = 512 << 20  # bytes a task may use for it
    sample_rows: int = 10_000  # rows from which cut points are taken, or bins**2 where that is more
    max_nodes: int = -1  # open nodes worked on in one pass over the rows; -1: as many as fit a task's memory
    skip_accuracy: bool = False  # no test after training
    output_tree: bool = False
    log_stats: bool = True
    dataset: str = ""
    file_type: str = "LIBSVM"
    sparse: bool = False  # LIBSVM data keep only their stored entries
    category: str = ""  # two specs parted by a semicolon or "|": arity of categorical features, remap of their raw values
    output: str = ""  # shared folder for statistics, tree dump and model
    categorical: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("num_trees", "depths", "bin_numbers", "multipliers"):
            v = getattr(self, name)
            v = tuple(sorted(v if isinstance(v, (list, tuple)) else (v,)))
            if not v or min(v) <= 0:
                raise ValueError(f"{name} needs values above 0")
            object.__setattr__(self, name, v)
        if max(self.depths) > 29:
            raise ValueError("depths beyond 29 have node numbers beyond 32 bits")

    def category_specs(self) -> tuple[dict[int, int], dict[int, int]]:
        """{feature: categories} and {raw value: category} of ``category``."""
        arity, _, remap = self.category.replace("|", ";").partition(";")
        return parse_arity(arity, self.num_features), parse_remap(remap)

    def collapsed(self) -> ForestParams:
        """Without model selection every list keeps its largest value."""
        if self.model_selection:
            return self
        return replace(self, **{n: (max(getattr(self, n)),) for n in ("num_trees", "depths", "bin_numbers", "multipliers")})

    def with_features(self, n: int) -> ForestParams:
        p = replace(self, num_features=n)
        return replace(p, categorical=p.category_specs()[0]) if p.category else p

    def plain(self) -> ForestParams:
        """For turned points: no categories, and no bags, as each rotation sees all rows."""
        return replace(self, categorical={}, poisson_mean=None)

    def with_trees(self, n: int) -> ForestParams:
        return replace(self, num_trees=(n,))

    def grid(self) -> list[tuple[int, int, float]]:
        """(forest, bin number, multiplier) of every combination, in order."""
        return [(i, b, m) for i, (b, m) in enumerate((b, m) for b in self.bin_numbers for m in self.multipliers)]


def doubling(low: int, high: int) -> list[int]:
    """low, 2 low, 4 low, ... up to high."""
    out = []
    while low <= high:
        out.append(low)
        low *= 2
    return out


def stepping(low: int, high: int, step: int) -> list[int]:
    return list(range(low, high + 1, step))


FEATURE_STRATEGIES: dict[str, Callable[[int], float]] = {
    "all": lambda n: n,
    "sqrt": lambda n: math.ceil(math.sqrt(n)),
    "sqrtsqrt": lambda n: math.ceil(n**0.25),
    "log2": lambda n: math.ceil(math.log2(n)) if n > 1 else 1,
    "onethird": lambda n: math.ceil(n / 3),
}
SPLIT_STRATEGIES: dict[str, Callable] = {}


def register_feature_strategy(name: str, candidates: Callable[[int], float]) -> None:
    """Adds a way to choose the number of candidates from the number of features."""
    FEATURE_STRATEGIES[name.lower()] = candidates


def register_split_strategy(name: str, thresholds: Callable) -> None:
    """Adds a way to choose thresholds: a function of (feature, value rows; bins; seed) that gives feature, thresholds."""
    SPLIT_STRATEGIES[name.lower()] = thresholds


def strategy_thresholds(name: str) -> Callable:
    from grovelight.operators import discretize as dz

    own = {"distribution": lambda long, bins, seed: dz.thresholds_by_distribution(cut(dz.value_counts(long)), bins), "random": dz.thresholds_at_random}
    return (own | SPLIT_STRATEGIES)[name.lower()]


def features_per_node(strategy: str | int, n: int, multiplier: float = 1.0) -> int:
    """Candidate features of a node: all, a given number, or a root or logarithm of n; never more than n."""
    k = strategy if isinstance(strategy, int) else FEATURE_STRATEGIES[strategy.lower()](n)
    return max(1, min(n, math.ceil(k * multiplier)))


def from_file(path: str | Path) -> ForestParams:
    """Reads ``key=value`` lines; lists are parted by commas; # starts a comment; unknown keys are left out."""
    got: dict = {}
    kinds = {f.name: f.type for f in fields(ForestParams)}
    for line in Path(path).read_text().splitlines():
        key, eq, value = line.split("#", 1)[0].partition("=")
        name = FILE_KEYS.get(key.strip())
        if not eq or name is None:
            continue
        value, kind = value.strip(), str(kinds[name])
        if kind.startswith("tuple"):
            number = float if "float" in kind else int
            got[name] = tuple(number(x) for x in value.split(","))
        elif kind == "bool":
            got[name] = value.lower() == "true"
        elif kind.startswith(("int", "float")):
            got[name] = int(value) if kind == "int" else float(value)
        else:
            got[name] = int(value) if name == "feature_strategy" and value.isdigit() else value
    if not got.get("dataset"):
        raise ValueError("dataset is required")
    got.setdefault("num_features", 0)  # 0: the trainer counts them in the data
    return ForestParams(**got).with_features(got["num_features"])


def parse_arity(spec: str, n: int) -> dict[int, int]:
    """'-1:4' (all features) or '1:4,3:5' as {feature: number of categories}."""
    pairs = [tuple(map(int, p.split(":"))) for p in spec.split(",") if p]
    return {f: k for i, k in pairs for f in (range(n) if i == -1 else [i])}


def parse_remap(spec: str) -> dict[int, int]:
    """'1:0,2:1' as {raw value: category}."""
    return {a: b for a, b in (tuple(map(int, p.split(":"))) for p in spec.split(",") if p)}
