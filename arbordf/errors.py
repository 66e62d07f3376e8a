"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class AnalysisError(EngineError):
    """A statement or call that is well formed but means nothing."""


class ParseError(EngineError):
    """A statement that can't be read. ``line`` and ``column`` count from 1."""

    def __init__(self, message: str, text: str = "", line: int = 1, column: int = 1):
        self.line, self.column = line, column
        lines = text.splitlines() or [""]
        shown = lines[min(line, len(lines)) - 1]
        super().__init__(f"{message} at line {line}, column {column}\n{shown}\n{' ' * (column - 1)}^")
