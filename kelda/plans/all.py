"""Every catalogue of the core."""

from kelda.plans import audit, backtest, contracts, entities, evaluation, gate, notices, periods, prose, records, search, signals, streams

catalogs = [m.catalog for m in (periods, contracts, notices, audit, signals, entities, search, evaluation, backtest, gate, prose, records, streams)]
