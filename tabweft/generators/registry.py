"""Generators by name."""

from __future__ import annotations

#: Name -> "module:class"; loaded when asked for.
_KNOWN = {
    "univariate": "tabweft.generators.base:UnivariateGenerator",
    "smote": "tabweft.generators.base:SMOTEGenerator",
    "synthpop": "tabweft.generators.trees:SynthpopGenerator",
    "arf": "tabweft.generators.trees:ARFGenerator",
    "xgbdiffusion": "tabweft.generators.boosted:BoostedFlowGenerator",
    "xgbddpm": "tabweft.generators.boosted:BoostedDiffusionGenerator",
    "tabddpm": "tabweft.generators.tabddpm:TabDDPMGenerator",
}
#: Known designs whose networks are not built yet.
_NEURAL = ("tabsyn", "tabdiff", "cdtd", "tabcascade", "ctgan", "tvae")


def all_generators() -> list[str]:
    return sorted(_KNOWN)


def get_generator(name: str):
    """The class; ValueError for an unknown name, NotImplementedError for one that is not built yet."""
    import importlib

    if name in _NEURAL:
        raise NotImplementedError(f"{name} is not built yet; generators are {all_generators()}")
    if name not in _KNOWN:
        raise ValueError(f"unknown generator {name!r}; generators are {all_generators()}")
    module, _, kind = _KNOWN[name].partition(":")
    return getattr(importlib.import_module(module), kind)
