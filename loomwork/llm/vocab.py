"""Finding the files of public tokenizers; they are never copied here."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder`` where given, else where the installed ``public_tokenizers`` has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
