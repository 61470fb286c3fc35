"""DataFrame operators: requests, comparison, changes, audit, reconciliation, validation, governance."""
