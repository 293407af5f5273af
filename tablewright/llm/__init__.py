"""Operators a training-data pipeline needs beside the table analytics of the library."""
