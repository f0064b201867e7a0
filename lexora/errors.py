"""Exceptions of the engine, under one base."""


class LexoraError(Exception):
    pass


class BaselineSchemaError(LexoraError):
    pass


class IcuSyntaxError(LexoraError):
    pass


class SpellerNotAvailable(LexoraError):
    pass


class SpellerProcessError(LexoraError):
    pass


class UnsupportedLanguage(LexoraError):
    pass
