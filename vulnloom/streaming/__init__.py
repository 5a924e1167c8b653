"""Rescanning file versions as they arrive."""
