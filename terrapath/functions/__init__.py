"""Column functions: geography, glide arithmetic and colours."""
