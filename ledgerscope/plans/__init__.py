"""Query catalog. ``load_all()`` imports every plan module (which registers
its queries) and returns the catalog module."""
import importlib

_MODULES = ["q_features", "q_profile", "q_metrics", "q_quality", "q_spikes", "q_decide", "q_models", "q_artifacts", "q_streaming"]


def load_all():
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.catalog")
