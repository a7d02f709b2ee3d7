"""netloom: attributed-network analytics and equilibrium estimation on Spark."""

from __future__ import annotations

from pathlib import Path


def reachable(spark) -> None:
    """Let Python workers that see this folder import the package from it, wherever the driver was started.

    On a cluster without a shared code folder, ship the package with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
