"""Column functions and vectorised kernels' plumbing."""
