"""Diagnostics of the compiler."""


class CompileError(Exception):
    """A proposal that can't be compiled; ``code`` names the rule, ``requirement`` the part it stands in."""

    def __init__(self, code: str, message: str = "", requirement: str | None = None):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.requirement = code, requirement
