"""Failures with a stable code and a verdict on whether a retry can help."""

from __future__ import annotations


class QuillonError(Exception):
    code = "BK_CORPUS_ERROR"

    def __init__(self, message: str, *, transient: bool = False):
        self.message, self.transient = message, transient
        super().__init__(message)

    def __str__(self) -> str:
        advice = "Retrying may succeed." if self.transient else "Retrying will not change this; change the input instead."
        return f"[{self.code}] {self.message} {advice}"


class ValidityError(QuillonError):
    code = "BK_VALIDITY_UNKNOWN"


class ManifestError(QuillonError):
    code = "BK_MANIFEST_INVALID"


class StoreError(QuillonError):
    code = "BK_CORPUS_STORE"


class CorpusError(QuillonError):
    code = "BK_CITE_UNRESOLVED"


class FormexError(QuillonError):
    code = "BK_FORMEX_PARSE"


class CamlError(QuillonError):
    code = "BK_CAML_PARSE"


class PdfError(QuillonError):
    code = "BK_PDF_EXTRACT"


class FetchError(QuillonError):
    code = "BK_EURLEX_FETCH"
