"""Graph operators on edges (src, dst, w) that hold both directions, and covers (comm_id, member)."""
