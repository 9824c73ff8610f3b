"""Token counters that are programs of their own: text on standard input, a number on standard output."""

from __future__ import annotations

import shlex
import subprocess

from ..errors import CallbackError


class CommandCounter:
    """Counts tokens with a command; it can be sent to executors, which must have the program."""

    def __init__(self, command: str, timeout: float | None = None):
        self.command, self.timeout = shlex.split(command), timeout

    def __call__(self, text: str) -> int:
        try:
            done = subprocess.run(self.command, input=text, capture_output=True, text=True, timeout=self.timeout, check=True)
            return int(done.stdout.strip())
        except subprocess.TimeoutExpired as e:
            raise CallbackError(f"{self.command[0]} took more than {self.timeout} seconds") from e
        except (OSError, subprocess.CalledProcessError) as e:
            raise CallbackError(f"{self.command[0]} failed: {getattr(e, 'stderr', '') or e}") from e
        except ValueError as e:
            raise CallbackError(f"{self.command[0]} must print one integer") from e
