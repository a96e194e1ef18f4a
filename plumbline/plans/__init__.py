"""Runnable plans over the supplied tables."""

from __future__ import annotations

from plumbline.plans.registry import PLANS, Plan


def catalogue() -> dict[str, Plan]:
    from plumbline.plans import (  # noqa: F401
        analog_plans,
        feature_plans,
        governance_plans,
        job_plans,
        model_plans,
        portfolio_plans,
        risk_plans,
        store_plans,
        validation_plans,
    )

    return dict(PLANS)
