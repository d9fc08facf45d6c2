"""Alert dispatch within the hourly budget."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from driftloom.config import AlertBudgetConfig
from driftloom.operators.greedy import alert_budget
from driftloom.session import stage

LOG = logging.getLogger(__name__)


def dispatch_alerts(
    alerts: DataFrame,
    channels: list[Callable[[DataFrame], None]] = [],
    cfg: AlertBudgetConfig = AlertBudgetConfig(),
) -> DataFrame:
    """Alerts that were sent. Each channel is a sink for the whole table of admitted alerts.

    Budget slots are taken before any channel runs, and a failing channel stops no other.
    """
    sent = alert_budget(alerts, cfg).filter("dispatched")
    if channels:
        sent = stage(sent, "sent")  # one fold, however many channels read it
    for channel in channels:
        try:
            channel(sent)
        except Exception as exc:  # noqa: BLE001 - one broken sink must not silence the rest
            LOG.warning("alert channel %r failed: %s", channel, exc)
    return sent
