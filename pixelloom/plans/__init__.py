"""Registered queries over the driver's tables and their SQL counterparts."""

import importlib

for _module in ("sources", "frames", "boxes", "pixels", "stencil", "detect", "measure", "models", "constrain", "fit", "metrics"):
    importlib.import_module(f"pixelloom.plans.q_{_module}")
