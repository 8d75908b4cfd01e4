"""Diagnostics: stable codes and messages that never hold data values."""

from __future__ import annotations


class Diagnostic(Exception):
    """A coded error. L0xx names, L1xx types and steps, L2xx sources, L3xx reconciliation, L4xx validation, L5xx outputs."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class AnalysisError(Diagnostic):
    """The program is wrong, whatever the data are."""


class RunError(Diagnostic):
    """The data break a contract."""
