"""Where the files of public tokenizers are; they are never copied."""

from __future__ import annotations


def default_path(name: str) -> str:
    """The place of a vocabulary file as the installed ``public_tokenizers`` names it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
