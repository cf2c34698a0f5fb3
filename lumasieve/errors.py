"""Typed errors of the command interface; each renders as {kind, message}."""

from __future__ import annotations

# The kinds, as callers of the interface tell errors apart by them.


class EngineError(Exception):
    kind = "Engine"

    def as_dict(self) -> dict[str, str]:
        return {"kind": self.kind, "message": str(self)}


class AnalyzerError(EngineError):
    kind = "Sidecar"


class StoreError(EngineError):
    kind = "Db"


class FileError(EngineError):
    kind = "Io"


class NotFound(EngineError):
    kind = "NotFound"


class Invalid(EngineError):
    kind = "Validation"
