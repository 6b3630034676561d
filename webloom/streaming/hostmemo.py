"""The host memo over a stream of attempts: each host's count of silences until it answers, once and for all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "domain string, n_silent long, answered boolean, written_off boolean"
STATE = "n_silent long, answered boolean"


def host_memo(attempts: DataFrame, threshold: int) -> DataFrame:
    """A streaming table of (domain, silent) to each domain's latest state; written in update mode."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, answered = state.get if state.exists else (0, False)
        for batch in batches:
            n += int(batch["silent"].sum())
            answered = bool(answered or (~batch["silent"]).any())
        state.update((n, answered))
        yield pd.DataFrame({"domain": [key[0]], "n_silent": [n], "answered": [answered], "written_off": [threshold > 0 and not answered and n >= threshold]})

    return attempts.groupBy("domain").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
