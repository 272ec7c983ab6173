"""Operators: recognizers, span algebra, coreference, masking, vault, chat shapes, model detectors and reports."""
