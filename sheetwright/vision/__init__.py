"""Pixel kernels in numpy and the recogniser protocol, behind Arrow-based functions."""
