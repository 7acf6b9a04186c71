"""Scalar functions: native Column expressions (text, files) and, for trees and codecs, pure functions with Arrow wrappers."""
