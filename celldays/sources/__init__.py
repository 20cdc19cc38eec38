"""Readers and writers of the table forms that the pipeline exchanges."""
