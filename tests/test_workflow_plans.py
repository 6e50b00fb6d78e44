"""The long cascades of the incident workflow are plans of their own."""

import test_workflow as W

loaded = W.loaded  # the load that the other tests of the workflow judge


def test_the_cascades_of_a_playbook_are_written_one_by_one(loaded):
    flow, _, got = loaded
    parts = {"playbook_policies", "playbook_approvals", "playbook_refusals", "rerun_expectations", "rerun_requests", "rerun_outcomes", "rerun_states"}
    assert parts <= set(flow.tables.finished())
    # What the whole plan says of a playbook is unchanged: granted, refused, lost, and verified by a rerun.
    W.test_playbook_needs_its_own_fresh_approval(loaded)
    W.test_every_incident_ends_as_its_stages_say(loaded)
